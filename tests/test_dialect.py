import pytest

from basalt.dialect import interval_parts, to_spark, tokens


@pytest.mark.parametrize(
    ("text", "wanted"),
    [
        ('SELECT "Odd Name" FROM t', "SELECT `Odd Name` FROM t"),
        ("SELECT $1, $2", "SELECT :p1, :p2"),
        ("SELECT STDDEV(x) FROM t", "SELECT stddev_pop (x) FROM t"),
        ("SELECT a FROM t WHERE a IN ()", "SELECT a FROM t WHERE false"),
        ("SELECT a FROM t WHERE t.a NOT IN ()", "SELECT a FROM t WHERE true"),
        ("SELECT 'it''s' -- note", "SELECT 'it\\'s'"),
        ("SELECT $q$ $1 \"x\" $q$", "SELECT ' $1 \"x\" '"),
        ("SELECT DATE '03/15/1998'", "SELECT DATE '1998-03-15'"),
        ("SELECT d + INTERVAL '1 month 2 days'", "SELECT d + INTERVAL '1' MONTH + INTERVAL '2' DAY"),
        ("SELECT d - INTERVAL '1 month 2 days'", "SELECT d - INTERVAL '1' MONTH - INTERVAL '2' DAY"),
        ("SELECT INTERVAL '90' DAY", "SELECT INTERVAL '90' DAY"),
    ],
)
def test_rewrites(text, wanted):
    assert to_spark(text) == wanted


def test_intervals():
    assert interval_parts("1 year 2 weeks 01:30") == ["INTERVAL '12' MONTH", "INTERVAL '14' DAY", "INTERVAL '5400.000000' SECOND"]
    with pytest.raises(ValueError):
        interval_parts("3 fortnights")


def test_unreadable():
    with pytest.raises(ValueError):
        tokens("SELECT 'open")
    with pytest.raises(ValueError):
        tokens("SELECT $q$ open")


def test_interval_factors():
    from basalt.dialect import to_spark

    assert to_spark("d + INTERVAL '1 month 2 days' * (n + 1)") == "d + INTERVAL '1' MONTH * (n + 1) + INTERVAL '2' DAY * (n + 1)"
    assert to_spark("d - 3 * INTERVAL '1 month 2 days'") == "d - 3 * INTERVAL '1' MONTH - 3 * INTERVAL '2' DAY"


def test_functions_follow_the_dialect(spark):
    from basalt.engine import Engine

    e = Engine(spark, "")
    one = e.sql("SELECT floor(-1.5) AS f, round(2.5) AS r, trim(' \u00a0x ') AS t, substring('abc', 0, 2) AS s, substring('abc' FROM 2) AS u, length('h\u00e9') AS n, ltrim(lower('  A')) AS l").first()
    assert tuple(one) == (-2.0, 3.0, "x", "ab", "bc", 2, "a")
    for text in ("SELECT sqrt(-1)", "SELECT power(10, 400)"):
        with pytest.raises(Exception, match="SQRT|POWER"):
            e.sql(text).collect()
