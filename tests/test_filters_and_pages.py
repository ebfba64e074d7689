import pytest
from pyspark.sql import functions as F

from dataward.errors import BadRequestError
from dataward.operators import counting, paging
from dataward.operators.where import UNDEFINED, InvalidOperatorError, applies_to_table, compile_where, extract_columns, has_operators, validate_operators
from dataward.plans import inspect

ROWS = [(1, "a%b", 10.0, None), (2, "a_b", 20.0, "x"), (3, "acb", None, "y"), (4, None, 40.0, "x")]


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(ROWS, "id long, name string, amount double, tag string")


@pytest.mark.parametrize(
    "where,ids",
    [
        ({}, [1, 2, 3, 4]),
        (None, [1, 2, 3, 4]),
        ({"tag": None}, [1]),
        ({"tag": {"$ne": "x"}}, [3]),
        ({"tag": {"$eq": None}}, [1]),
        ({"tag": {"$ne": None}}, [2, 3, 4]),
        ({"id": {"$in": []}}, []),
        ({"id": {"$in": "12"}}, []),
        ({"id": {"$nin": []}}, [1, 2, 3, 4]),
        ({"tag": {"$nin": ["x"]}}, [3]),
        ({"name": {"$contains": "%"}}, [1]),
        ({"name": {"$contains": "_"}}, [2]),
        ({"name": {"$like": "a_b"}}, [1, 2, 3]),
        ({"name": {"$startsWith": "a%"}}, [1]),
        ({"name": {"$endsWith": "b"}}, [1, 2, 3]),
        ({"amount": {"$between": [10, 20]}}, [1, 2]),
        ({"amount": {"$between": [10]}}, [1, 2, 3, 4]),
        ({"amount": {"$isNull": True}}, [3]),
        ({"amount": {"$isNull": False}}, [1, 2, 4]),
        ({"amount": {"$isNotNull": True}}, [1, 2, 4]),
        ({"amount": {"$isNotNull": "yes"}}, [1, 2, 3, 4]),
        ({"amount": {"$gt": 10, "$lt": 40}}, [2]),
        ({"amount": {"$gt": UNDEFINED}, "tag": UNDEFINED}, [1, 2, 3, 4]),
        ({"$or": []}, [1, 2, 3, 4]),
        ({"$and": []}, [1, 2, 3, 4]),
        ({"$or": [{"id": 1}, {"$and": [{"tag": "x"}, {"amount": {"$gte": 40}}]}]}, [1, 4]),
    ],
)
def test_where(df, where, ids):
    assert sorted(r["id"] for r in df.filter(compile_where(where)).collect()) == ids


def test_unknown_operators_and_columns(df):
    for bad in ({"id": {"$gtt": 1}}, {"$or": {"id": 1}}, {"$not": []}, {"$or": [{"id": {"$regex": "x"}}]}):
        with pytest.raises(InvalidOperatorError):
            validate_operators(bad)
    with pytest.raises(BadRequestError):
        compile_where({"nope": 1}, df.columns)
    assert extract_columns({"a": 1, "$or": [{"b": {"$gt": 1}}, {"a": 2}]}) == ["a", "b"]
    assert has_operators({"a": {"$gt": 1}}) and not has_operators({"a": {"x": 1}})


def test_table_lists():
    assert applies_to_table("a", ["a"], ["a"]) and not applies_to_table("b", ["a"]) and not applies_to_table("a", [], ["a"]) and applies_to_table("a")


def test_pages(df):
    page = paging.paginate(df, 2, 3, [("id", "asc")])
    assert [r["id"] for r in page.data.collect()] == [4] and (page.total, page.total_pages, page.has_next, page.has_prev) == (4, 2, False, True)
    assert paging.paginate(df, 1, 0).total_pages == 0 and paging.paginate(df, 0, float("nan")).limit == 20
    assert paging.paginate(df, 10**9, 10**9).page == 1_000_000 and paging.paginate(df, 1, 10**9).limit == 10_000
    assert paging.apply_offset(df.orderBy("id"), 0, -3).count() == 1


@pytest.mark.parametrize("order", [[("id", "asc")], [("tag", "desc"), ("id", "asc")]])
@pytest.mark.parametrize("security", [None, paging.CursorSecurity("s" * 32), paging.CursorSecurity("k" * 32, "sha512", True)])
def test_cursor_walk(df, order, security):
    rows, cursor, seen = df.filter("tag is not null"), None, []
    while True:
        page = paging.paginate_cursor(rows, order, cursor, 2, security)
        seen += [r["id"] for r in page.data]
        if not page.has_next:
            break
        cursor = page.next_cursor
    assert seen == [r["id"] for r in rows.orderBy(*paging.sort_columns(order)).collect()]


def test_cursors():
    order = [("a", "asc"), ("b", "desc")]
    assert paging.decode_cursor(paging.encode_cursor(order, {"a": "é:ö", "b": None})) == {"a": "é:ö", "b": None}
    assert paging.encode_cursor([("id", "asc")], {"id": 5}) == "aWQ=:NQ==" and paging.decode_cursor("aWQ=:NQ==") == {"id": 5}
    for bad in ("%%%", "aWQ=", "aWQ=:!!"):
        with pytest.raises(BadRequestError):
            paging.decode_cursor(bad)
    with pytest.raises(BadRequestError):
        paging.after(order, {"a": 1})
    with pytest.raises(BadRequestError):
        paging.CursorSecurity("short")


def test_signed_cursor_must_hold(df):
    security = paging.CursorSecurity("s" * 32)
    cursor = paging.paginate_cursor(df, [("id", "asc")], None, 1, security).next_cursor
    with pytest.raises(BadRequestError):
        paging.paginate_cursor(df, [("id", "asc")], "x" + cursor, 1, security)
    with pytest.raises(BadRequestError):
        paging.paginate_cursor(df, [("id", "asc")], paging.encode_cursor([("id", "asc")], {"id": 1}), 1, security)


def test_counts(df):
    assert counting.grouped_counts(df, "tag") == {"null": 1, "x": 2, "y": 1}
    assert counting.exists(df, {"id": 3}) and not counting.exists(df, {"id": 9}) and counting.count_rows(df, {"tag": "x"}) == 2


def test_filters_reach_the_scan(spark, tmp_path, df):
    df.write.parquet(str(tmp_path / "t"))
    rows = spark.read.parquet(str(tmp_path / "t")).filter(compile_where({"amount": {"$gte": 20}, "tag": {"$in": ["x"]}})).select("id")
    facts = inspect.facts(rows)
    assert facts.scans == 1 and "GreaterThanOrEqual(amount,20.0)" in facts.pushed[0] and facts.cartesian == facts.python == 0
    assert "name" not in facts.read_schemas[0]
    assert inspect.query_warnings("SELECT * FROM t WHERE a LIKE '%x' OR b") and F
