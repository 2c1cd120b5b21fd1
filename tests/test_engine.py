"""Semantics on small tables, answers worked out by hand."""

from datetime import datetime

import pytest

from quillon import Engine, Session, TsqlError
from quillon.errors import from_spark


@pytest.fixture(scope="module")
def e(spark):
    e = Engine(spark)
    boats = [(11, "heron", "Delft", 9.5, 4), (12, "Tern", "DELFT", 12.0, 2), (13, "", "Hoorn", None, 6), (14, "gull", None, -1.5, 2), (15, "Avocet", "hoorn ", 31.25, None), (16, "skua", "Sneek", 0.0, 0), (17, "knot", "Delft", 7.75, 5)]
    e.register("boats", spark.createDataFrame(boats, "no int, hull string, port string, length double, berths int"))
    trips = [(501, 11, "out", 2), (502, 11, "back", None), (503, 12, "out", 9), (504, 17, "late", 4), (505, 99, "out", 1)]
    e.register("trips", spark.createDataFrame(trips, "code int, boat int, status string, days int"))
    e.register("nested", spark.createDataFrame([(1, "x")], "no int, `port.name` string"))
    e.register("patterns", spark.createDataFrame([("a%b", "a!%b", "!"), ("ax", "[^a]x", "~"), ("bx", "[^a]x", "~"), ("c]", "_]", "~"), ("d-1", "d[-x][0-9]", "~"), ("e.", "e.", "~"), ("f", None, "~"), ("g[", "g[", "~"), ("H_H", "h~_h", "~"), ("h1h", "h~_h", "~")], "t string, p string, m string"))
    return e


def got(e, sql, **params):
    return [tuple(r) for r in e.query(sql, params).collect()]


def value(e, sql):
    return got(e, f"SELECT {sql} AS v")[0][0]


@pytest.mark.parametrize(
    ("sql", "want"),
    [
        ("7 / 2", 3), ("-7 / 2", -3), ("7 / 2.0", 3.5), ("-7 % 3", -1), ("'a' + 'b'", "ab"), ("'5' + 1", 6), ("1 + NULL", None), ("5 & 3", 1), ("5 | 3", 7), ("5 ^ 3", 6), ("~5", -6),
        ("LEN('ab  ')", 2), ("DATALENGTH('ab  ')", 4), ("SUBSTRING('abc', 0, 2)", "a"), ("SUBSTRING('abcdef', -1, 4)", "ab"), ("CHARINDEX('B', 'abc')", 2), ("CHARINDEX('', 'abc')", 0), ("CHARINDEX('a', 'banana', 3)", 4),
        ("STUFF('abcdef', 2, 3, 'X')", "aXef"), ("STUFF('abc', 9, 1, 'X')", None), ("STUFF('abc', 2, 1, NULL)", "ac"), ("PATINDEX('%[0-9]%', 'ab3c')", 3), ("PATINDEX('b%', 'abc')", 0), ("REPLACE('ada', 'A', 'x')", "ada"),
        ("QUOTENAME('a]b')", "[a]]b]"), ("QUOTENAME('a', '''')", "'a'"), ("LEFT('abc', 9)", "abc"), ("RIGHT('abc', 0)", ""), ("REVERSE('abc')", "cba"), ("REPLICATE('a', -1)", None), ("SPACE(2) + '|'", "  |"),
        ("LTRIM('  a ') + '|'", "a |"), ("TRIM('x' FROM 'xaX')", "a"), ("UPPER('ß')", "SS"), ("ASCII('A')", 65), ("ASCII('')", None), ("CHAR(65)", "A"), ("CHAR(300)", None), ("NCHAR(960)", "π"), ("TRANSLATE('abc', 'ab', 'xy')", "xyc"),
        ("CONCAT('a', NULL, 1)", "a1"), ("CONCAT_WS(',', 'a', NULL, 'b')", "a,b"), ("CHOOSE(3, 'a', 'b')", None), ("IIF(NULL = 1, 'y', 'n')", "n"), ("GREATEST(1, '2', NULL)", 2), ("LEAST('b', 'A')", "A"),
        ("ISNULL(NULL, 'x')", "x"), ("NULLIF('a', 'A')", "a"), ("COALESCE(NULL, 2, 'x')", 2), ("COALESCE(NULL, 2)", 2), ("SIGN(-2.5)", -1), ("FLOOR(2.5)", 2.0), ("CEILING(-2.5)", -2.0), ("ROUND(1.005, 2)", 1.01),
        ("ROUND(-2.5, 0)", -3.0), ("ROUND(1234, -2)", 1200), ("ROUND(2.789, 1, 1)", 2.7), ("POWER(2, 10)", 1024), ("SQUARE(3)", 9.0), ("SQRT(16)", 4.0), ("LOG(8, 2)", pytest.approx(3.0)), ("EXP(0)", 1.0), ("STR(0.5)", "0.5"),
        ("CAST(2.9 AS int)", 2), ("CAST('' AS int)", 0), ("CAST(' 12 ' AS int)", 12), ("CAST('true' AS bit)", True), ("CAST(200 AS tinyint)", 200), ("CAST(12.345 AS decimal(10, 2))", 12.35), ("CAST('abcdef' AS varchar(3))", "abc"),
        ("CAST('a' AS char(3)) + '|'", "a  |"), ("CAST(12345 AS varchar(3))", "*"), ("CAST(CAST('2024-01-15 13:05' AS datetime) AS varchar(30))", "Jan 15 2024  1:05PM"), ("CAST(1234567.0E0 AS varchar(30))", "1.23457e+006"),
        ("CAST(0.1E0 AS varchar(30))", "0.1"), ("CAST(12.50 AS varchar(30))", "12.50"), ("CAST(CAST(2.5 AS money) AS varchar(30))", "2.50"), ("TRY_CAST('x' AS int)", None), ("TRY_CONVERT(datetime, 'zz')", None), ("TRY_CAST(300 AS tinyint)", None),
        ("CONVERT(varchar(30), CAST('2024-01-05 09:07:03' AS datetime), 0)", "Jan  5 2024  9:07AM"), ("CONVERT(varchar(30), CAST('2024-01-05' AS datetime), 103)", "05/01/2024"), ("CONVERT(varchar(30), CAST('2024-01-05' AS datetime), 126)", "2024-01-05T00:00:00"),
        ("DATEDIFF(year, '2023-12-31', '2024-01-01')", 1), ("DATEDIFF(month, '2024-01-31', '2024-02-01')", 1), ("DATEDIFF(hour, '2024-01-01 00:59', '2024-01-01 01:00')", 1), ("DATEDIFF(week, '2024-01-06', '2024-01-07')", 1),
        ("DATEPART(week, '2026-12-31')", 53), ("DATEPART(week, '2026-01-04')", 2), ("DATEPART(dw, '2024-01-14')", 1), ("DATENAME(weekday, '2024-01-15')", "Monday"), ("DATENAME(year, '2024-01-15')", "2024"),
        ("DATEADD(month, 1, '2024-01-31')", datetime(2024, 2, 29)), ("EOMONTH('2024-02-05', 1)", datetime(2024, 3, 31)), ("CAST(0 AS datetime)", datetime(1900, 1, 1)), ("CAST('15 Jan 2024' AS date)", datetime(2024, 1, 15)), ("CAST(CAST('1900-01-02 12:00' AS datetime) AS float)", 1.5),
        ("CASE WHEN 'a' = 'A ' THEN 1 ELSE 0 END", 1), ("CASE WHEN 'ab' LIKE 'A_' THEN 1 ELSE 0 END", 1), ("CASE WHEN 'a%b' LIKE 'a!%b' ESCAPE '!' THEN 1 ELSE 0 END", 1), ("CASE WHEN 'a ' LIKE 'a' THEN 1 ELSE 0 END", 0), ("CASE WHEN 'x-y' LIKE '[a-z][-]%' THEN 1 ELSE 0 END", 1),
        ("CASE WHEN NULL IN (1, NULL) THEN 1 ELSE 0 END", 0), ("CASE WHEN NOT (1 NOT IN (1, NULL)) THEN 1 ELSE 0 END", 1), ("(SELECT COUNT(*) FROM boats)", 7), ("DB_NAME()", "master"), ("@@MAX_PRECISION", 38), ("CASE 'RED' WHEN 'red' THEN 1 END", 1),
    ],
)
def test_values(e, sql, want):
    assert value(e, sql) == want


@pytest.mark.parametrize(
    ("sql", "want"),
    [
        ("SELECT port, COUNT(*) AS n FROM boats GROUP BY port ORDER BY n DESC, port", [("DELFT", 3), ("Hoorn", 2), (None, 1), ("Sneek", 1)]),
        ("SELECT AVG(berths) AS a, SUM(berths) AS s, COUNT(berths) AS c FROM boats", [(3, 19, 6)]),
        ("SELECT hull FROM boats WHERE port = 'delft ' ORDER BY no", [("heron",), ("Tern",), ("knot",)]),
        ("SELECT no FROM boats WHERE port <> 'DELFT' ORDER BY no", [(13,), (15,), (16,)]),
        ("SELECT no FROM boats WHERE no NOT IN (SELECT days FROM trips)", []),
        ("SELECT no FROM boats b WHERE berths >= ALL (SELECT days FROM trips WHERE boat = b.no) ORDER BY no", [(13,), (14,), (16,), (17,)]),
        ("SELECT no FROM boats b WHERE berths < ANY (SELECT days FROM trips WHERE boat = b.no) ORDER BY no", [(12,)]),
        ("SELECT no FROM boats WHERE berths > ALL (SELECT days FROM trips WHERE code > 503) ORDER BY no", [(13,), (17,)]),
        ("SELECT DISTINCT port FROM boats ORDER BY port", [(None,), ("Delft",), ("Hoorn",), ("Sneek",)]),
        ("SELECT DISTINCT port, berths / 4 AS q FROM boats WHERE berths > 1 ORDER BY port, q", [(None, 0), ("DELFT", 0), ("Delft", 1), ("Hoorn", 1)]),
        ("SELECT TOP 4 WITH TIES berths FROM boats ORDER BY berths DESC", [(6,), (5,), (4,), (2,), (2,)]),
        ("SELECT TOP 50 PERCENT no FROM boats ORDER BY no", [(11,), (12,), (13,), (14,)]),
        ("WITH a AS (SELECT no FROM boats WHERE no > 13) SELECT TOP 50 PERCENT no FROM a ORDER BY no", [(14,), (15,)]),
        ("SELECT TOP (@n) no FROM boats ORDER BY no DESC", [(17,), (16,)]),
        ("SELECT b.no, x.code FROM boats b OUTER APPLY (SELECT TOP 1 code FROM trips t WHERE t.boat = b.no ORDER BY code DESC) x WHERE b.no < 14 ORDER BY 1", [(11, 502), (12, 503), (13, None)]),
        ("SELECT b.no, (SELECT MAX(x) FROM (VALUES (b.no), (b.berths * 4)) q(x)) AS m FROM boats b WHERE no < 13 ORDER BY 1", [(11, 16), (12, 12)]),
        ("SELECT port FROM boats UNION SELECT 'SNEEK' EXCEPT SELECT 'delft' ORDER BY 1", [(None,), ("hoorn",), ("sneek",)]),
        ("SELECT COUNT(*) AS n WHERE 1 = 0", [(0,)]), ("SELECT 1 AS x WHERE 1 = 0", []), ("SELECT SUM(berths) AS s FROM boats WHERE no > 99", [(None,)]),
        ("SELECT STRING_AGG(port, '/') WITHIN GROUP (ORDER BY no) AS s FROM boats", [("Delft/DELFT/Hoorn/hoorn /Sneek/Delft",)]),
        ("SELECT STRING_AGG(hull, CHAR(43) + '-') WITHIN GROUP (ORDER BY no) AS s FROM boats WHERE no > 15", [("skua+-knot",)]),
        ("SELECT [port.name] AS t, no FROM nested", [("x", 1)]), ("SELECT port.name AS t FROM nested", [("x",)]),
        ("SELECT b.port, COUNT(*) AS n FROM boats b JOIN trips t ON t.boat = b.no GROUP BY b.port HAVING n > 1", [("DELFT", 4)]),
        ("SELECT no, LAG(no, berths, -1) OVER (ORDER BY no) AS d FROM boats ORDER BY no", [(11, -1), (12, -1), (13, -1), (14, 12), (15, -1), (16, 16), (17, 12)]),
        ("SELECT no, LAG(no, berths, -1) OVER (ORDER BY no) + 0 AS d FROM boats ORDER BY no DESC", [(17, 12), (16, 16), (15, -1), (14, 12), (13, -1), (12, -1), (11, -1)]),
        ("SELECT TOP 4 no, LEAD(hull, no - 10, port) OVER (PARTITION BY port ORDER BY no) AS d, berths FROM boats WHERE no < 17 ORDER BY d, no", [(14, None, 2), (12, "DELFT", 2), (13, "Hoorn", 6), (15, "hoorn ", None)]),
        ("WITH a AS (SELECT no FROM boats), b AS (SELECT no FROM a WHERE no > 15) SELECT * FROM b ORDER BY no", [(16,), (17,)]),
        ("WITH a AS (SELECT no, port FROM boats WHERE no < 15) SELECT x.no FROM a x JOIN a y ON y.port = x.port AND y.no > x.no WHERE EXISTS (SELECT 1 FROM a z WHERE z.no = y.no)", [(11,)]),
        ("SELECT t, CASE WHEN t LIKE p ESCAPE m THEN 1 ELSE 0 END AS y FROM patterns ORDER BY t", [("a%b", 1), ("ax", 0), ("bx", 1), ("c]", 1), ("d-1", 1), ("e.", 1), ("f", 0), ("g[", 1), ("h1h", 0), ("H_H", 1)]),
        ("SELECT t FROM patterns WHERE t LIKE p ESCAPE '!' ORDER BY t", [("a%b",), ("bx",), ("c]",), ("d-1",), ("e.",), ("g[",)]),
        ("SELECT t, PATINDEX('%' + p + '%', 'zz' + t) AS i FROM patterns WHERE m = '~' ORDER BY t", [("ax", 0), ("bx", 3), ("c]", 3), ("d-1", 3), ("e.", 3), ("f", None), ("g[", 3), ("h1h", 0), ("H_H", 0)]),
        ("SELECT b.no FROM boats b WHERE EXISTS (SELECT 1 FROM trips t WHERE t.boat = b.no AND EXISTS (SELECT 1 FROM trips u WHERE u.boat = t.boat AND u.days < b.berths)) ORDER BY 1", [(11,), (17,)]),
        ("SELECT b.no, (SELECT COUNT(*) FROM trips t WHERE t.code IN (SELECT u.code FROM trips u WHERE u.boat = b.no AND u.code = t.code)) AS n FROM boats b WHERE b.no < 14 ORDER BY 1", [(11, 2), (12, 1), (13, 0)]),
        ("SELECT COUNT(DISTINCT berths) AS d, SUM(DISTINCT berths) AS s, COUNT(DISTINCT port) AS p, COUNT(*) AS n, MAX(length) AS m FROM boats GROUP BY LEFT(port, 0) ORDER BY n", [(1, 2, 0, 1, -1.5), (5, 17, 3, 6, 31.25)]),
        ("SELECT port, COUNT(DISTINCT berths) AS d, AVG(DISTINCT berths) AS a, SUM(no) AS s, COUNT(*) AS n FROM boats GROUP BY port ORDER BY port", [(None, 1, 2, 14, 1), ("DELFT", 3, 3, 40, 3), ("Hoorn", 1, 6, 28, 2), ("Sneek", 1, 0, 16, 1)]),
    ],
)
def test_queries(e, sql, want):
    found = got(e, sql, n=2)
    if "UNION" in sql:  # which spelling a set operator keeps, and its trailing blanks, are open
        found = [tuple(v.lower().rstrip() if isinstance(v, str) else v for v in r) for r in found]
    assert found == want


@pytest.mark.parametrize(
    ("sql", "number"),
    [
        ("SELECT nope FROM boats", 207), ("SELECT * FROM nope", 208), ("SELECT x.no FROM boats", 4104), ("SELECT no FROM boats a JOIN boats b ON a.no = b.no", 209), ("SELECT port, no FROM boats GROUP BY port", 8120),
        ("SELECT no FROM boats WHERE hull", 4145), ("SELECT 1 +", 102), ("SELECT 'x", 105), ("SELECT /* x", 113), ("SELECT FROM boats", 156), ("SELECT ROW_NUMBER() FROM boats", 10753), ("SELECT ROW_NUMBER() OVER () FROM boats", 4112),
        ("SELECT no FROM boats WHERE ROW_NUMBER() OVER (ORDER BY no) = 1", 4108), ("SELECT DISTINCT RANK() OVER (ORDER BY no) FROM boats", 10759), ("SELECT NTILE(0) OVER (ORDER BY no) FROM boats", 4116), ("SELECT LAG(no, -1) OVER (ORDER BY no) FROM boats", 8730),
        ("SELECT SUM(no) OVER (ORDER BY no RANGE 1 PRECEDING) FROM boats", 4194), ("SELECT RANK() OVER (ORDER BY no ROWS 1 PRECEDING) FROM boats", 10752), ("SELECT SUM(no) OVER (ORDER BY no ROWS BETWEEN 1 FOLLOWING AND 1 PRECEDING) FROM boats", 4193),
        ("SELECT no FROM boats UNION SELECT no, hull FROM boats", 205), ("SELECT (SELECT no, hull FROM boats)", 116), ("SELECT TOP 1 WITH TIES no FROM boats", 1062), ("SELECT SUM(COUNT(*)) FROM boats", 130), ("SELECT COUNT(*) FROM boats GROUP BY 1", 164),
        ("SELECT SUM(hull) FROM boats", 8117), ("SELECT CASE WHEN 1 = 1 THEN NULL END", 8133), ("SELECT COALESCE(NULL, NULL)", 4127), ("SELECT @x", 137), ("SELECT DATEPART(nope, '2024-01-01')", 155), ("SELECT CONVERT(varchar, GETDATE(), 99)", 281),
        ("SELECT * FROM (VALUES (1, 2), (3)) v(a, b)", 10709), ("SELECT * FROM (VALUES (1, 2)) v(a)", 8158), ("SELECT * FROM (SELECT 1) d", 8155), ("SELECT no FROM boats GROUP BY ROLLUP(no)", 50000), ("WITH r AS (SELECT 1 AS n UNION ALL SELECT n FROM r) SELECT * FROM r", 50000),
        ("SELECT x.* FROM boats", 107), ("SELECT p.nope FROM boats p", 207), ("SELECT no FROM @t", 1087), ("SELECT no FROM boats GROUP BY no HAVING COUNT(*) OVER () = 1", 4108), ("SELECT CAST(1 AS nope)", 243), ("SELECT NOPE(1)", 195), ("SELECT SUBSTRING(12, 1, 1)", 8116),
    ],
)
def test_refused(e, sql, number):
    with pytest.raises(TsqlError) as error:
        e.query(sql)
    assert error.value.number == number


@pytest.mark.parametrize(
    ("sql", "number"),
    [
        ("1 / 0", 8134), ("1 % 0", 8134), ("CAST('abc' AS int)", 245), ("CAST('abc' AS float)", 8114), ("CAST('abc' AS datetime)", 241), ("CAST(300 AS tinyint)", 220), ("LOG(-1)", 3623), ("SQRT(-1)", 3623), ("EXP(1000)", 8115),
        ("DATEADD(year, 9000, '2024-01-01')", 517), ("TRANSLATE('a', 'ab', 'c')", 9828), ("SUBSTRING('abc', 1, -1)", 536), ("CAST(1e20 AS int)", 232), ("CAST(12345.6 AS decimal(4, 1))", 8115),
    ],
)
def test_fails_when_run(e, sql, number):
    with pytest.raises(Exception) as error:
        e.query(f"SELECT {sql} AS v").collect()
    assert from_spark(error.value).number == number


@pytest.mark.parametrize(
    ("sql", "want"),
    [
        ("DECLARE @i int = 0, @s nvarchar(50) = ''; WHILE @i < 3 BEGIN SET @i += 1; IF @i = 2 CONTINUE; SET @s = @s + CAST(@i AS varchar) END SELECT @i, @s", [[(3, "13")]]),
        ("CREATE TABLE #t (id int NOT NULL, nm nvarchar(5)); INSERT #t VALUES (1, 'a'), (2, 'b'); INSERT INTO #t (id) SELECT 3; UPDATE #t SET nm = nm + 'x' WHERE id < 3; DELETE FROM #t WHERE id = 1; SELECT * FROM #t ORDER BY id; SELECT @@ROWCOUNT", [[(2, "bx"), (3, None)], [(2,)]]),
        ("BEGIN TRY SELECT 1 / 0 END TRY BEGIN CATCH SELECT ERROR_NUMBER(), ERROR_MESSAGE() END CATCH", [[(8134, "Divide by zero error encountered.")]]),
        ("BEGIN TRY THROW 50005, 'boo', 3 END TRY BEGIN CATCH SELECT ERROR_NUMBER(), ERROR_STATE() END CATCH", [[(50005, 3)]]),
        ("DECLARE @s nvarchar(max) = ''; SELECT @s = @s + hull + ',' FROM boats ORDER BY no; SELECT @s, @@ROWCOUNT", [[("heron,Tern,,gull,Avocet,skua,knot,", 7)]]),
        ("DECLARE @a int; SELECT @a = no FROM boats ORDER BY no; SELECT @a, @@ROWCOUNT", [[(17, 7)]]),
        ("SELECT no, hull INTO #x FROM boats WHERE no < 13; SELECT COUNT(*) FROM #x; EXEC('SELECT 5')", [[(2,)], [(5,)]]),
        ("CREATE TABLE #e (a int); INSERT #e EXEC('SELECT 7'); TRUNCATE TABLE #e; INSERT #e EXEC('SELECT 8'); SELECT a FROM #e", [[(8,)]]),
        ("IF EXISTS (SELECT 1 FROM boats WHERE no = 99) SELECT 'y' ELSE SELECT 'n'", [[("n",)]]),
        ("EXEC sp_databases", [[("master", 0, None)]]),
        ("SELECT COUNT(*) FROM sysobjects WHERE name = 'BOATS'; SELECT name FROM dbo.sysusers; SELECT COUNT(*) FROM sys.foreign_keys; SELECT COUNT(*) FROM INFORMATION_SCHEMA.VIEWS", [[(1,)], [("dbo",)], [(0,)], [(0,)]]),
        ("EXEC sp_tables_rowset @table_name = 'trips'; SELECT @@ROWCOUNT; EXEC sp_foreign_keys_rowset; SELECT @@ROWCOUNT", None),
        ("DECLARE @n int = 0, @t nvarchar(20) = ''; SELECT @n += berths, @t = CASE WHEN @n > 8 THEN @t + LEFT(hull, 1) ELSE @t END FROM boats WHERE berths > 0 ORDER BY no; SELECT @n, @t", [[(19, "gk")]]),
        ("DECLARE @n int; SELECT @n = no FROM boats WHERE no > 99; SELECT @n, @@ROWCOUNT", [[(None, 0)]]),
        ("SELECT 1 AS a INTO #d; DROP TABLE #d; SELECT 2 AS a INTO #d; SELECT a FROM #d", [[(2,)]]),
        ("EXEC('SELECT @@NESTLEVEL'); SELECT @@NESTLEVEL", [[(1,)], [(0,)]]),
        ("SELECT OBJECT_ID(hull) - OBJECT_ID('boats'), OBJECT_ID(port) FROM (VALUES ('dbo.[Boats]', 'none')) v(hull, port)", [[(0, None)]]),
        ("CREATE TABLE #p (a int); INSERT #p VALUES (11), (9); UPDATE #p SET a += 5 WHERE a IN (SELECT no FROM boats); SELECT a FROM #p ORDER BY a", [[(9,), (16,)]]),
    ],
)
def test_batches(e, sql, want):
    a = e.answer(sql, session=Session(e))
    if want is None:
        assert not a.errors and [r.df.count() for r in a.results] == [1, 1, 0, 1] and a.results[3].df.first()[0] == 0
        return
    assert not a.errors and [[tuple(r) for r in x.df.collect()] for x in a.results] == want


@pytest.mark.parametrize(
    ("sql", "numbers"),
    [
        ("BREAK", [135]), ("SELECT 1; SELECT @x", [137]), ("IF 1 = 1 SELECT 1; DECLARE @y int; SET @z = (SELECT COUNT(*) FROM boats WHERE no = @y)", [137]), ("RAISERROR('x', 16, 1); THROW 50001, 'y', 1", [50000, 50001]), ("EXEC('SELECT * FROM none'); SELECT 1 / 0", [208, 8134]), ("EXEC('SELECT CAST(''x'' AS int)'); SELECT 1 / 0", [245]), ("COMMIT", [3902]), ("ROLLBACK", [3903]), ("THROW", [10704]), ("THROW 1, 'x', 1", [35100]), ("INSERT boats VALUES (1)", [50000]), ("DROP TABLE #none", [3701]),
        ("CREATE TABLE #u (a varchar(2)); INSERT #u VALUES ('abc')", [2628]), ("CREATE TABLE #u (a int NOT NULL); INSERT #u VALUES (NULL)", [515]), ("CREATE TABLE #u (a int); CREATE TABLE #u (a int)", [2714]), ("CREATE TABLE #u (a int, A int)", [2705]),
        ("CREATE TABLE #u (a int); INSERT #u VALUES (1, 2)", [213]), ("SELECT 1 / 0; SELECT 1", [8134]), ("RAISERROR('x %d', 16, 1, 5)", [50000]), ("EXEC nope", [2812]), ("MERGE x", [50000]), ("SELECT 1 SELEC 2 FROM", [102]),
    ],
)
def test_batch_errors(e, sql, numbers):
    assert [x.number for x in e.answer(sql, session=Session(e)).errors] == numbers


def test_what_stays_of_a_batch_that_fails(e):
    kept = lambda sql: [len(r.df.collect()) for r in e.answer(sql, session=Session(e)).results]
    assert kept("SELECT 1 AS a; SELECT 1 / 0 AS b; SELECT 2 AS c") == [1, 0, 1]  # goes on, and the columns were sent
    assert kept("SET XACT_ABORT ON; SELECT 1 AS a; SELECT 1 / 0 AS b; SELECT 2 AS c") == [1, 0]
    assert kept("SELECT 1 AS a; SELECT * FROM none; SELECT 2 AS c") == [1]  # found when it runs
    assert kept("SELECT 1 AS a; SELECT nope FROM boats; SELECT 2 AS c") == []  # found when it is compiled
    assert kept("SELECT 1 AS a; SELECT @x") == []
    assert kept("SELECT 1 AS a; DROP TABLE #none; SELECT 2 AS c") == [1, 1]


def test_files_go_with_their_tables(e, spark):
    from pathlib import Path

    from quillon import store

    folder = Path(store.shared_dir(spark).removeprefix("file://")) / "tables"
    before = set(folder.glob("*"))
    s = Session(e)
    e.answer("SELECT no INTO #a FROM boats; SELECT no INTO #b FROM boats; SELECT COUNT(*) FROM #a; DROP TABLE #a", session=s)
    assert len(set(folder.glob("*")) - before) == 2  # #b and the result
    s.reset()
    assert set(folder.glob("*")) == before


def test_tables_are_looked_at_when_named(spark, sf):
    e = Engine(spark).register_parquet(sf, ["region", "no_such_table"])
    assert e.query("SELECT COUNT(*) AS n FROM region").first().n == 5


def test_sessions_keep_their_tables_and_reset(e):
    s = Session(e)
    e.answer("SELECT 1 AS a INTO #k; BEGIN TRAN", session=s)
    assert s.tran_count == 1 and e.answer("SELECT a FROM #k", session=s).df.first().a == 1
    s.reset()
    assert s.tran_count == 0 and e.answer("SELECT a FROM #k", session=s).errors[0].number == 208


def test_headings_and_kinds(e):
    r = e.prepare("SELECT no, no + 1, COUNT(*) OVER () AS n, hull AS no FROM boats")
    assert r.headings == ("no", "", "n", "no") and [k.name for k in r.kinds] == ["int", "bigint", "int", "text"] and len(set(r.df.columns)) == 4


def test_scans_are_pruned_and_filters_pushed(e, spark, sf):
    e.register("orders", spark.read.parquet(f"{sf}/orders.parquet"))
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = e.query("SELECT o_orderkey FROM orders WHERE o_totalprice > 1000 AND o_orderdate >= '1996-01-01'")._jdf.queryExecution().toString()
    assert "GreaterThan(o_totalprice,1000.0)" in plan and "GreaterThanOrEqual(o_orderdate" in plan
    assert "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double,o_orderdate:timestamp_ntz>" in plan


def test_stream(spark, tmp_path):
    from quillon.streaming import stream_query

    spark.createDataFrame([(1, "a"), (2, "A "), (3, "b")], "id int, k string").write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("id int, k string").parquet(str(tmp_path / "in"))
    q = stream_query(Engine(spark), "SELECT id * 2 AS d FROM s WHERE k = 'a'", {"s": s}).writeStream.format("memory").queryName("quillon_out").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.d for r in spark.sql("SELECT * FROM quillon_out").collect()) == [2, 4]


def test_text_groups_hash_first(e, spark, sf):
    e.register("lines", spark.read.parquet(f"{sf}/lineitem.parquet"))
    df = e.query("SELECT l_returnflag, COUNT(*) AS n, AVG(l_quantity) AS q, MIN(l_linestatus) AS m FROM lines GROUP BY l_returnflag HAVING COUNT(*) > 1")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate(keys=[l_returnflag" in plan or "SortAggregate(key=[l_returnflag" in plan  # a text minimum sorts
    plan = e.query("SELECT l_returnflag, COUNT(*) AS n, SUM(l_quantity) AS q FROM lines GROUP BY l_returnflag")._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate(keys=[l_returnflag" in plan
    assert df.count() == 3
