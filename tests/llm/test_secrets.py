import hashlib
import re

from quillon.llm import secrets as S

from .cases import awkward, empty

KEEP = {"assign": lambda m: len(m[2]) >= 6, "access": lambda m: len(m[0]) >= 20, "hex": lambda m: len(m[0]) >= 24}
BASE = {
    "assign": re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII),
    "access": re.compile(r"AKIA[A-Z0-9]+"), "hex": re.compile(r"[0-9a-f]+"),
}
WEAK = {"identifier": re.compile(S.IDENTIFIER, re.ASCII), "secret": re.compile(S.SECRET), "endpoint": re.compile(S.ENDPOINT, re.ASCII)}
KEEP["secret"] = lambda m: all(re.search(c, m[0]) for c in ("[0-9]", "[a-z]", "[A-Z]"))


def brute(text):
    text = text or ""
    of = lambda d: [(m.start(), S.KINDS.index(k), m.end()) for k, p in d.items() for m in p.finditer(text) if KEEP.get(k, lambda m: True)(m)]
    base, weak = of(BASE), of(WEAK)
    over = lambda a, b: a[0] < b[2] and b[0] < a[2]
    weak = [w for w in weak if not any(over(w, b) for b in base)]
    done = lambda w, o: S.KINDS[o[1]] in S.COMPLEMENTS[S.KINDS[w[1]]] and not over(w, o) and w[0] - o[2] <= S.SCOPE and o[0] - w[2] <= S.SCOPE
    linked = [w for w in weak if any(done(w, o) for o in base + weak)]
    wr = lambda x: ",".join(f"{S.KINDS[k]}:{a}:{b}" for a, k, b in sorted(x))
    n = lambda k: sum(b[1] == k for b in base)
    return n(0), n(1), n(2), hashlib.sha256(wr(base).encode()).hexdigest(), wr(base + linked), len(linked)


def same(docs):
    got = sorted(((r.doc_id is None, r.doc_id or 0), tuple(r)[1:]) for r in S.scan(docs).collect())
    want = sorted(((r.doc_id is None, r.doc_id or 0), brute(r.text)) for r in docs.select("doc_id", "text").collect())
    assert got == want


def test_documents(spark, sf):
    same(spark.read.parquet(f"{sf}/documents.parquet"))


def test_planted(spark):
    key, random = "AKIA" + "Z9" * 9, "aB3" * 8
    texts = [
        f"é😀 password = 'hunter22' and TOKEN:abc token=token: abcdef {key}", f"{key}{key} AKIA AKIA12 x{'0a' * 12}Y {'f' * 23} {'f' * 24}",
        f"user=bob then {random}", f"{random} alone", f"user=bob alone, {'pad ' * 60} {random}", f"https://x.example/a {random} https://y.example", "https://x.example login: me.too",
        f"username: ann {'z' * 190} {random} " + "w " * 100 + f"client_id=abc {'0a' * 12}", f"secret={random} account=abcd", "\n".join(f"user=u{i}xx {random}{i} " for i in range(300)), f"{random} " * 3000 + "user=abc",
        "api_key\"  :   \"abc.def-12\" ApiKey=short apikey=longer1", "ſecret=abcdefgh Kpassword=abcdefg",
    ]
    same(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))


def test_awkward(spark):
    same(awkward(spark))
    assert S.scan(empty(spark)).collect() == []


def test_an_address_around_a_base_part_counts(spark):
    text = f"https://api.example.com/v1?token=abcdef99 {'aB3' * 6}"
    got = S.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert got.spans == "endpoint:0:41,assign:27:41,secret:42:60" and got.n_linked == 2
