import pytest
from pyspark.sql import functions as F

from rowtide.operators import access, aggregates, read as r, sets
from rowtide.operators.read import Embed, Param


@pytest.fixture(scope="module")
def tables(spark):
    make = lambda rows, schema: spark.createDataFrame(rows, schema)
    return {
        "notes": make([("n1", "hello"), ("n2", None)], "id string, note string"),
        "owners": make([("a", "Alpha"), ("b", "Beta"), ("c", "Gamma")], "id string, name string"),
        "appearances": make([(1, "a", 10, True), (2, "a", None, True), (3, "a", 0, True), (4, "a", 900, False), (5, "b", 30, True),
                             (6, "b", 40, True), (7, "c", None, True)], "id int, owner_id string, minutes int, included boolean"),
        "team": make([(1, "Alpha United", "BR", "a"), (2, "Secret FC", "AR", "b")], "id int, name string, country string, scope_id string"),
        "card": make([(1, 1, 2, "a"), (2, 2, 1, "a"), (3, 1, None, "a"), (4, 2, 2, "b")], "id int, home_id int, away_id int, scope_id string"),
        "composite": make([(1, 1, "correct"), (1, 2, "other")], "part int, id int, label string"),
        "paired": make([(10, 1, 1)], "id int, c_part int, c_id int"),
    }


def ids(df, col="id"):
    return sorted(x[col] for x in df.collect())


def test_a_pattern_of_wildcards_only_means_not_null(tables):
    assert ids(r.where(tables["notes"], [("note", "like", "*")])) == ["n1"]
    assert ids(r.where(tables["notes"], [("note", "not.like", "*")])) == []


def test_empty_in_is_false_and_not_keeps_null(tables):
    t = tables["appearances"]
    assert ids(r.where(t, [("minutes", "in", [])])) == []
    assert ids(r.where(t, [("minutes", "not.eq", 10)])) == [3, 4, 5, 6]
    assert ids(r.where(t, [("minutes", "is", "null")])) == [2, 7]
    assert ids(r.where(t, [("included", "is", "false")])) == [4]
    assert ids(r.where(t, [("or", [("minutes", "gt", 30), ("owner_id", "eq", "c")])])) == [4, 6, 7]


def test_a_missing_parameter_binds_null(tables):
    t = tables["appearances"]
    assert ids(r.where(t, [("owner_id", "eq", Param(2))], ["a"])) == []
    assert ids(r.where(t, [("owner_id", "any", Param(1))], [["b", "c"]])) == [5, 6, 7]
    assert ids(r.where(t, [("owner_id", "any", Param(3))], [["b"]])) == []


def test_nulls_are_skipped_by_aggregates_but_counted(tables):
    out = r.aggregate(tables["appearances"], ["owner_id"], {"s": ("sum", "minutes"), "a": ("avg", "minutes"), "n": ("count", "*"), "m": ("count", "minutes")}, ["owner_id"])
    assert [tuple(x) for x in out.collect()] == [("a", 910, 910 / 3, 4, 3), ("b", 70, 35.0, 2, 2), ("c", None, None, 1, 0)]
    with pytest.raises(ValueError):
        r.aggregate(tables["appearances"], ["owner_id"], {"n": ("count", "*")}, ["n"])


def test_embeds(tables):
    look = tables.__getitem__
    home = Embed("home", "team", [("home_id", "id")], select=("name",))
    away = Embed("away", "team", [("away_id", "id")], select=("name",))
    got = {x["id"]: x for x in r.read(look, "card", ["id"], embeds=[home, away]).collect()}
    assert got[1]["home"]["name"] == "Alpha United" and got[1]["away"]["name"] == "Secret FC" and got[3]["away"] is None
    inner = Embed("away", "team", [("away_id", "id")], inner=True, where=[("country", "eq", "BR")])
    assert ids(r.read(look, "card", ["id"], embeds=[inner])) == [2]
    pair = Embed("composite", "composite", [("c_part", "part"), ("c_id", "id")], select=("label",))
    assert r.read(look, "paired", ["id"], embeds=[pair]).first()["composite"]["label"] == "correct"


def test_hidden_rows_are_hidden_in_embeds_too(tables):
    see = access.scoped_lookup(tables.__getitem__, ["a", ""])
    got = {x["id"]: x["away"] for x in r.read(see, "card", ["id"], embeds=[Embed("away", "team", [("away_id", "id")])]).collect()}
    assert sorted(got) == [1, 2, 3] and got[1] is None and got[2]["id"] == 1
    assert access.visible(tables["team"], []).count() == 0


def test_many_embed_continues_in_parts(tables):
    spec = Embed("apps", "appearances", [("id", "owner_id")], many=True, select=("id",), order=("id",), size=3)
    got = [(x["id"], x["apps_part"], [y["id"] for y in x["apps"]]) for x in r.read(tables.__getitem__, "owners", ["id"], embeds=[spec]).collect()]
    assert sorted(got) == [("a", 0, [1, 2, 3]), ("a", 1, [4]), ("b", 0, [5, 6]), ("c", 0, [7])]
    none = Embed("apps", "appearances", [("id", "owner_id")], many=True, where=[("minutes", "gt", 10000)], order=("id",), size=3)
    assert [x["apps"] for x in r.read(tables.__getitem__, "owners", ["id"], embeds=[none]).collect()] == [[], [], []]


def test_ambiguous_relations_and_depth(tables):
    relations = {"home": Embed("home", "team", [("home_id", "id")]), "away": Embed("away", "team", [("away_id", "id")])}
    with pytest.raises(ValueError, match="ambiguous"):
        r.pick_relation(relations, "team")
    assert r.pick_relation(relations, "team", "away_id").key == "away"
    deep = Embed("x", "owners", [("id", "id")])
    for _ in range(16):
        deep = Embed("x", "owners", [("id", "id")], embeds=(deep,))
    with pytest.raises(ValueError, match="levels deep"):
        r.read(tables.__getitem__, "owners", ["id"], embeds=[deep])


def test_select_refuses_duplicate_keys(tables):
    with pytest.raises(ValueError):
        r.select(tables["owners"], ["id", "id:name"])


def test_text_match_is_by_whole_words(spark):
    df = spark.createDataFrame([(1, "Les mots, ÉTÉ"), (2, "été motsx"), (3, None)], "id int, t string")
    assert ids(r.where(df, [("t", "plfts", "été MOTS")])) == [1]


def test_page_bounds(tables):
    t = tables["appearances"]
    got = lambda *a: tuple(aggregates.count_exact(t, *a).first())
    assert got(3) == (0, 2, 7) and got(3, 6) == (6, 6, 7) and got(3, 7) == (None, None, 7)


def test_defaults_do_not_replace_nulls(tables):
    out = r.with_defaults(tables["notes"], {"note": ("string", "x"), "level": ("int", 3)})
    assert sorted((x["id"], x["note"], x["level"]) for x in out.collect()) == [("n1", "hello", 3), ("n2", None, 3)]


def test_digest_ignores_order_and_counts_copies(spark):
    d = lambda rows: r.digest(spark.createDataFrame(rows, "a int, b string")).first()["digest"]
    assert d([(1, "x"), (2, "y")]) == d([(2, "y"), (1, "x")]) != d([(1, "x"), (2, "y"), (2, "y")])


def test_capture_refuses_long_rows(spark):
    df = spark.createDataFrame([("x" * 100,)], "t string")
    assert r.capture_text(df, 200).first()[0] == '{"t":"' + "x" * 100 + '"}'
    with pytest.raises(Exception, match="capture limit"):
        r.capture_text(df, 50).collect()


def test_union_keeps_a_row_while_any_source_has_it(spark):
    rows = lambda *ks: spark.createDataFrame([(k, 1, "v") for k in ks], "id string, seq int, v string")
    have = lambda **s: ids(sets.union_refcount(s, ["id"], "seq"))
    assert have(base=rows("a"), grant=rows("a", "x")) == ["a", "x"]
    assert have(base=rows("a")) == ["a"] and have(base=rows("a"), grant=rows("x").where("false")) == ["a"]


def test_closure_ends_on_cycles_and_diamonds(spark):
    edges = spark.createDataFrame([(1, 2), (1, 3), (2, 4), (3, 4), (4, 1), (5, 6)], "src int, dst int")
    assert ids(sets.closure(edges, spark.createDataFrame([(2,)], "node int")), "node") == [1, 2, 3, 4]


def test_symmetric_difference_counts_copies(spark):
    bag = lambda *v: spark.createDataFrame([(x,) for x in v], "v string")
    assert [tuple(x) for x in sets.symmetric_difference(bag("a", "a", "b"), bag("a", "b")).collect()] == [("a", 1, "left")]
    assert sets.bag_difference(bag("a", "b"), bag("a").where("false")).count() == 2


def test_key_pages(spark):
    df = spark.createDataFrame([(i, "x" * i) for i in (0, 1, 2, 5, 9)], "k long, v string")
    page = lambda *a: ids(r.key_page(df, "k", *a), "k")
    assert page(-1, 2, 1000) == [0, 1] and page(1, 10, 1000) == [2, 5, 9]
    one = len('{"k":0,"v":""}')  # brackets and a comma count too
    assert page(-1, 5, 2 * one + 1 + 3) == [0, 1] and page(-1, 5, 2 * one + 1 + 2) == [0]
    with pytest.raises(Exception, match="exceeds"):
        page(5, 5, 10)
    with pytest.raises(ValueError, match="increase"):
        r.key_page(df.unionByName(df), "k", 1, 2, 1000)
    with pytest.raises(ValueError, match="whole"):
        r.key_page(df.withColumn("k", F.col("k") - 1), "k", -1, 2, 1000)


def test_scopes_come_from_the_parent(spark):
    from rowtide.operators.joins import scope_from_parent

    parent = spark.createDataFrame([(1, "s1"), (2, None)], "pid int, scope_id string")
    child = spark.createDataFrame([(10, 1, "own"), (11, 2, None), (12, 3, None)], "id int, p int, scope_id string")
    out = scope_from_parent(child, parent, [("p", "pid")])
    assert sorted((x["id"], x["scope_id"], x["violation"]) for x in out.collect()) == [(10, "s1", False), (11, None, True), (12, None, True)]
    assert ids(scope_from_parent(child, parent, [("p", "pid")], derived=True)) == [10]


def test_a_reader_without_a_name_has_only_public_rows(spark):
    readers = spark.createDataFrame([("u",), ("",), (None,)], "name string")
    assert sorted((x["scopes"] for x in access.reader_scopes(readers, "name").collect()), key=len) == [["public:"], ["public:"], ["public:", "user:u"]]
