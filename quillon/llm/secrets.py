"""Secret scans with multipart credential linking, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged

# Fixed values of the contract. A run of ACCESS or HEX is met as a whole, so asking for its least length keeps the same
# matches as dropping shorter ones; for ASSIGN that would differ, so it drops them after matching.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS, HEX = r"AKIA[A-Z0-9]{16,}", r"[0-9a-f]{24,}"
# The weak parts, which only linking reports.
IDENTIFIER = r"""(?i:\b(?:user(?:_?name|_?id)?|login|client_?id|account(?:_?id)?|access_?key(?:_?id)?))["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{3,}"""
SECRET = r"[A-Za-z0-9+/_-]{16,}={0,2}"
ENDPOINT = r"""(?i:\b(?:https?|ftp|ssh|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp)://)[^\s"'<>]{3,}"""
KINDS = ("assign", "access", "hex", "identifier", "secret", "endpoint")
BASE, LINKED = KINDS[:3], KINDS[3:]
#: What completes a weak part.
COMPLEMENTS = {"identifier": ("assign", "hex", "secret"), "secret": ("access", "identifier", "endpoint"), "endpoint": ("assign", "hex", "secret")}
#: Code points between two parts of one credential at most.
SCOPE = 200


def running(steps: Column) -> Column:
    """The running sums of an array of n numbers in n log n steps, within the row."""
    levels = F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.size(steps), F.lit(1)).cast("double"))).cast("int"))
    power = lambda k: F.call_function("shiftleft", F.lit(1), k)
    return F.aggregate(levels, steps, lambda a, k: F.transform(a, lambda x, i: x + F.when(i >= power(k), F.get(a, i - power(k))).otherwise(F.lit(0))))


def spans(text: Column, pattern: str, kind: int, keep=None) -> Column:
    """array<struct<start, kind, end>> of the leftmost non-overlapping matches, in code points; keep filters by the match.

    Splitting at the pattern gives the gaps between the matches, so places are running sums of lengths. Texts without a
    match do no more than look for one.
    """
    both = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda g, h: F.struct(F.length(g).alias("gap"), h.alias("hit")))
    found = F.filter(both, lambda b: b["hit"].isNotNull())
    bound = lambda of, make: F.element_at(F.transform(F.array(of), make), 1)  # noqa: E731  evaluates `of` once
    ends = lambda f: running(F.transform(f, lambda b: b["gap"] + F.length(b["hit"])))
    placed = bound(found, lambda f: F.zip_with(f, ends(f), lambda b, e: F.struct((e - F.length(b["hit"])).alias("start"), F.lit(kind).alias("kind"), e.alias("end"), b["hit"].alias("hit"))))
    kept = F.filter(placed, lambda p: keep(p["hit"])) if keep else placed
    out = F.transform(kept, lambda p: F.struct(p["start"].alias("start"), p["kind"].alias("kind"), p["end"].alias("end")))
    return F.when(text.rlike(pattern), out).otherwise(F.array().cast("array<struct<start:int,kind:int,end:int>>"))


def _mixed(hit: Column) -> Column:
    return hit.rlike("[0-9]") & hit.rlike("[a-z]") & hit.rlike("[A-Z]")


def written(found: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.concat_ws(",", F.transform(F.array_sort(found), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))))


def linked(parts: DataFrame, scope: int = SCOPE) -> DataFrame:
    """The weak parts of (doc, text_hash, start, kind, end) that a complementary part completes within the scope.

    An interval join: a part is listed under each block of code points that it covers, a weak part also under those that
    its scope reaches, so only parts of one document near one another meet. A name or an address within a base one, and a
    random-looking string that has characters of one, is the same thing twice, and doesn't count; a name or an address
    around a base one does.
    """
    number = KINDS.index
    blocks = lambda reach: F.explode(F.sequence(F.greatest(F.lit(0), F.floor((F.col("start") - reach) / scope)).cast("int"), F.floor((F.col("end") + reach) / scope).cast("int")))
    same = lambda a, b: F.col(f"{a}.doc").eqNullSafe(F.col(f"{b}.doc")) & (F.col(f"{a}.text_hash") == F.col(f"{b}.text_hash")) & (F.col(f"{a}.block") == F.col(f"{b}.block"))
    weak = parts.where(F.col("kind") >= len(BASE))
    at = parts.withColumn("block", blocks(0))
    over = (F.col("a.start") < F.col("b.end")) & (F.col("b.start") < F.col("a.end"))
    within = (F.col("b.start") <= F.col("a.start")) & (F.col("a.end") <= F.col("b.end"))
    twice = F.when(F.col("a.kind") == number("secret"), over).otherwise(within)
    hidden = weak.withColumn("block", blocks(0)).alias("a").join(at.where(F.col("kind") < len(BASE)).alias("b"), same("a", "b") & twice, "left_semi").drop("block").distinct()
    own = lambda d: [F.col(f"{d}.{c}") for c in ("text_hash", "start", "kind", "end")]
    free = parts.alias("p").join(hidden.alias("h"), F.col("p.doc").eqNullSafe(F.col("h.doc")) & F.array(*own("p")).eqNullSafe(F.array(*own("h"))), "left_anti")
    free = staged(free, "parts")
    completes = F.lit(False)
    for k, others in COMPLEMENTS.items():
        completes = completes | ((F.col("a.kind") == number(k)) & F.col("b.kind").isin([number(o) for o in others]))
    near = (F.col("a.start") - F.col("b.end") <= scope) & (F.col("b.start") - F.col("a.end") <= scope) & ~over
    a, b = free.where(F.col("kind") >= len(BASE)).withColumn("block", blocks(scope)), free.withColumn("block", blocks(0))
    return a.alias("a").join(b.alias("b"), same("a", "b") & completes & near, "left_semi").drop("block").distinct()


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_linked) of every row of docs, over whole texts.

    Base findings stand by themselves. Weak parts - an account name, a random-looking string, an address - are reported
    only near a part that completes them: a name or an address with a secret, a secret with a name or an address.

    Null texts count as empty and have no findings. Repeated rows get equal results; rows of one id with other texts are
    apart. Empty table: no rows. Other columns are ignored.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = own.select(
        "doc_id", F.xxhash64(text).alias("text_hash"),
        spans(text, ASSIGN, 0, lambda h: F.length(F.regexp_extract(h, ASSIGN, 2)) >= 6).alias("assign"), spans(text, ACCESS, 1).alias("access"), spans(text, HEX, 2).alias("hex"),
        spans(text, IDENTIFIER, 3).alias("identifier"), spans(text, SECRET, 4, _mixed).alias("secret"), spans(text, ENDPOINT, 5).alias("endpoint"),
    )
    found = staged(found, "spans")
    some = F.size("identifier") + F.size("secret") + F.size("endpoint")
    everything = some + F.size("assign") + F.size("access") + F.size("hex")
    parts = found.where((some > 0) & (everything > 1)).select(F.col("doc_id").alias("doc"), "text_hash", F.explode(F.concat(*KINDS)).alias("s")).select("doc", "text_hash", "s.*").distinct()
    more = linked(parts).groupBy("doc", "text_hash").agg(F.collect_list(F.struct("start", "kind", "end")).alias("linked"))
    out = found.alias("f").join(more.alias("m"), F.col("f.doc_id").eqNullSafe(F.col("m.doc")) & (F.col("f.text_hash") == F.col("m.text_hash")), "left")
    base, added = F.concat(*BASE), F.coalesce("linked", F.array().cast("array<struct<start:int,kind:int,end:int>>"))
    return out.select(
        "doc_id", *(F.size(k).cast("long").alias(f"n_{k}") for k in BASE), F.sha2(written(base), 256).alias("base_sha256"), written(F.concat(base, added)).alias("spans"), F.size(added).cast("long").alias("n_linked"),
    )
