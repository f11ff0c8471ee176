"""Movies and actors: the known results of the dialect's queries, through a stack's SQL and operators."""

import random

import pytest
from pyspark.sql.functions import udf

from folio.operators.joins import array_join
from folio.operators.rows import distinct_on, union
from folio.sources.schema import Attribute, ClassModel
from folio.sources.stack import Stack

ACTORS = [("Keanu Reeves", 1964), ("Carrie-Anne Moss", 1967), ("Laurence Fishburne", 1961), ("Leonardo DiCaprio", 1974), ("Ken Watanabe", 1959), ("Matthew McConaughey", 1969), ("Anne Hathaway", 1982), ("Guy Pearce", 1967)]
MOVIES = [("The Matrix", 1999, 8.7, [1, 2, 3]), ("Inception", 2010, 8.8, [4, 5]), ("Interstellar", 2014, 8.6, [6, 7]), ("Memento", 2000, 8.4, [8])]


@pytest.fixture(scope="module")
def movies(spark, tmp_path_factory):
    stack = Stack(spark, str(tmp_path_factory.mktemp("movies")))
    stack.create_class(ClassModel("Actor", (Attribute("name", mandatory=True, primary_key=True, max_length=200), Attribute("born", "integer", min=1900))))
    stack.create_class(ClassModel("Movie", (Attribute("title", mandatory=True, primary_key=True, max_length=200), Attribute("year", "integer", mandatory=True, min=1900), Attribute("rating", "decimal", min=0, max=10), Attribute("actors", is_array=True))))
    stack.write("Actor", spark.createDataFrame([(f"Actor-{i + 1}", *a) for i, a in enumerate(ACTORS)], "_id string, name string, born long"))
    stack.write("Movie", spark.createDataFrame([(f"Movie-{i + 1}", t, y, r, [f"Actor-{k}" for k in a]) for i, (t, y, r, a) in enumerate(MOVIES)], "_id string, title string, year long, rating double, actors array<string>"))
    return stack


def rows(df):
    return [tuple(r) for r in df.collect()]


CAST = "FROM Movie AS m CROSS JOIN LATERAL explode(m.actors) AS x(aid) JOIN Actor AS a ON a._id = x.aid"


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("SELECT title, year FROM Movie WHERE year >= 2000 ORDER BY year", [("Memento", 2000), ("Inception", 2010), ("Interstellar", 2014)]),
        (f"SELECT title, name AS actor_name {CAST} WHERE m.year >= 2000 ORDER BY title, actor_name", [("Inception", "Ken Watanabe"), ("Inception", "Leonardo DiCaprio"), ("Interstellar", "Anne Hathaway"), ("Interstellar", "Matthew McConaughey"), ("Memento", "Guy Pearce")]),
        ("SELECT title FROM Movie WHERE rating > (SELECT AVG(rating) FROM Movie) ORDER BY title", [("Inception",), ("The Matrix",)]),
        (f"SELECT name AS actor_name, title {CAST} WHERE m.rating >= (SELECT MAX(rating) FROM Movie WHERE year >= 2000) ORDER BY actor_name", [("Ken Watanabe", "Inception"), ("Leonardo DiCaprio", "Inception")]),
        ("SELECT title FROM Movie WHERE year >= 2000 UNION SELECT title FROM Movie WHERE year >= 2000 ORDER BY title", [("Inception",), ("Interstellar",), ("Memento",)]),
        ("SELECT title FROM Movie WHERE year >= 2000 UNION ALL SELECT title FROM Movie WHERE year >= 2000 ORDER BY title", [(t,) for t in ("Inception", "Inception", "Interstellar", "Interstellar", "Memento", "Memento")]),
        ("SELECT DISTINCT born FROM Actor ORDER BY born", [(x,) for x in (1959, 1961, 1964, 1967, 1969, 1974, 1982)]),
        (f"SELECT title, COUNT(*) AS actor_count {CAST} GROUP BY title HAVING COUNT(*) >= 2 ORDER BY actor_count DESC, title", [("The Matrix", 3), ("Inception", 2), ("Interstellar", 2)]),
        ("SELECT year, COUNT(*) AS n FROM Movie GROUP BY year UNION ALL SELECT year, COUNT(*) FROM Movie WHERE year >= 2000 GROUP BY year ORDER BY year", [(1999, 1), (2000, 1), (2000, 1), (2010, 1), (2010, 1), (2014, 1), (2014, 1)]),
        ('SELECT "title" FROM "Movie" WHERE "year" = 1999;', [("The Matrix",)]),
    ],
)
def test_known_results(movies, text, want):
    assert rows(movies.sql(text)) == want


def test_global_aggregate(movies):
    n, mean = rows(movies.sql("SELECT COUNT(*) AS total_movies, AVG(rating) AS avg_rating FROM Movie"))[0]
    assert (n, round(mean, 5)) == (4, 8.625)


def test_distinct_on(movies):
    cast = array_join(movies.scan("Movie").select("title", "actors"), movies.scan("Actor").select("_id", "name"), "actors")
    assert rows(distinct_on(cast.select("title", "name"), ["title"], ["title", "name"])) == [("Inception", "Ken Watanabe"), ("Interstellar", "Anne Hathaway"), ("Memento", "Guy Pearce"), ("The Matrix", "Carrie-Anne Moss")]


def test_parameters_empty_text_and_unknown_table(movies):
    assert rows(movies.sql("SELECT title FROM Movie WHERE year > :y", y=2010)) == [("Interstellar",)]
    assert movies.sql(" ; ").collect() == []
    with pytest.raises(KeyError, match="Table not found"):
        movies.scan("Nothing")


def test_array_join_edge_cases(spark):
    left = spark.createDataFrame([(1, ["a", "a"]), (2, ["x"]), (3, []), (4, None), (5, ["a", None, "x"])], "n int, ids array<string>")
    right = spark.createDataFrame([("a", 10), ("b", 20)], "_id string, v int")
    out = lambda how: sorted(((r.n, r.v) for r in array_join(left, right, "ids", how=how).select("n", "v").collect()), key=str)
    assert out("inner") == [(1, 10), (1, 10), (5, 10)]
    assert out("left") == [(1, 10), (1, 10), (2, None), (3, None), (4, None), (5, 10)]
    assert out("right") == [(1, 10), (1, 10), (5, 10), (None, 20)]
    assert sorted(r.n for r in array_join(left, right, "ids", how="semi").collect()) == [1, 5]
    assert sorted(r.n for r in array_join(left, right, "ids", how="anti").collect()) == [2, 3, 4]


def in_any_order(spark):
    """Rows whose arrays are in another order each time they are evaluated, as those of collect_list may be."""
    mixed = udf(lambda xs: random.sample(xs, len(xs)), "array<long>").asNondeterministic()
    left = spark.createDataFrame([(n, [n * 10 + i for i in range(8)]) for n in range(40)], "n long, ids array<long>").withColumn("ids", mixed("ids"))
    return left, spark.createDataFrame([(n * 10 + 3, n) for n in range(0, 40, 2)], "_id long, v long")


def test_array_left_join_of_arrays_in_any_order(spark):
    left, right = in_any_order(spark)
    assert sorted(rows(array_join(left, right, "ids", how="left").select("n", "v")), key=str) == sorted([(n, None if n % 2 else n) for n in range(40)], key=str)


def test_array_semi_join_of_arrays_in_any_order(spark):
    left, right = in_any_order(spark)
    assert sorted(r.n for r in array_join(left, right, "ids", how="semi").collect()) == list(range(0, 40, 2))


def test_array_anti_join_of_arrays_in_any_order(spark):
    left, right = in_any_order(spark)
    assert sorted(r.n for r in array_join(left, right, "ids", how="anti").collect()) == list(range(1, 40, 2))


def test_array_join_plans_no_nested_loop(spark):
    left = spark.createDataFrame([(1, ["a"])], "n int, ids array<string>")
    right = spark.createDataFrame([("a", 10)], "_id string, v int")
    for how in ("inner", "left", "right", "semi", "anti"):
        plan = array_join(left, right, "ids", how=how)._jdf.queryExecution().toString()
        assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_union_order_and_limit(spark):
    a, b = spark.createDataFrame([(1, "x"), (2, "y")], "i int, s string"), spark.createDataFrame([("y", 2), ("z", 3)], "s string, i int")
    assert rows(union([a, b], order=["-i"], limit=2)) == [(3, "z"), (2, "y")]
    assert len(rows(union([a, b], distinct=False))) == 4
