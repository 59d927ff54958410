import yaml
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioflow.functions import frontmatter as M

NOTES = [
    None,
    "",
    "no frontmatter\n---\na: 1\n---\n",
    "---\n---\nbody",
    "---\na: 1\n---\n",
    "---\n# c\na: 1\n---\nbody\n",
    "---\n\n# first\n\ntitle: 'x: y'  # why\n\ntags:\n- a\n-  b\n# between\n\n\"quoted key\": [1,\n  2]\nlast: |\n  text: here\n\n  more\n---\nbody: not a key\n---\nstill body",
    "---\r\na: 1\r\n# c\r\n\r\nb:\r\n  - x\r\n---\r\nbody\r\n",
    "---\na: 1\na: 2\n---\nx",
    "---\nnot yaml at all\nstill: {broken\n: odd\n---\nx",
    "---  \nkey with blanks : v\n'single': 2\n---\t\nx",
    "---\na: 1\n--- trailing\nb: 2\n---\n",
    "---\nurl: http://a:80/x\nb:c\ntime: 10:30\n---",
    "---\nopen: end",
]


def tiled(spark, notes):
    rows = spark.createDataFrame(list(enumerate(notes)), "i int, content string").select("i", M.tiled(F.col("content")).alias("n")).withColumn("again", M.project(F.col("n")))
    return sorted(rows.collect(), key=lambda r: r.i)


def test_what_is_projected_is_what_was_tiled(spark):
    found = tiled(spark, NOTES)
    assert [r.again for r in found] == NOTES
    assert found[5].n["keys"] == ["a"] and found[5].n["head"] == "# c\n"
    assert found[6].n["keys"] == ["title", "tags", "quoted key", "last"] and found[6].n["raws"][1] == "tags:\n- a\n-  b\n# between\n\n"
    assert found[7].n["keys"] == ["a", "b"] and found[7].n["raws"][0] == "a: 1\r\n# c\r\n\r\n"
    assert found[8].n["keys"] == ["a", "a"]
    assert found[12].n["keys"] == ["url", "time"] and found[12].n["raws"][0] == "url: http://a:80/x\nb:c\n"


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from(["---", "a: 1", "b:", "  - x", "# c", "", "'q': 2", "x", ":", "---\r", "a: 'y'\r", "\r"]), max_size=12).map("\n".join), min_size=20, max_size=40))
def test_any_text_comes_back(spark, notes):
    assert [r.again for r in tiled(spark, notes)] == notes


def test_keys_are_set_and_removed_in_their_place(spark):
    notes = [n for n in NOTES if n is not None]
    rows = spark.createDataFrame(list(enumerate(notes)), "i int, content string").withColumn("n", M.tiled(F.col("content")))
    rows = rows.withColumn("set", M.project(M.with_key(F.col("n"), "a", F.lit("a: new\n")))).withColumn("gone", M.project(M.without_key(F.col("n"), "a"))).orderBy("i").collect()
    for r in rows:
        before, after = r.n, spark.createDataFrame([(r.set,)], "c string").select(M.tiled(F.col("c")).alias("n")).first().n
        assert after["body"] == before["body"]
        mine = [k for k in before["keys"] if k != "a"]
        assert [k for k in after["keys"] if k != "a"] == mine and after["keys"].count("a") == 1
        assert after["raws"][after["keys"].index("a")].strip() == "a: new"
        if "a" in before["keys"]:
            assert after["keys"].index("a") == before["keys"].index("a")
    assert rows[4].set == "---\n# c\na: new\n---\nbody\n" and rows[4].gone == "---\n# c\n---\nbody\n"
    assert yaml.safe_load(rows[5].set.split("---\n")[1])["a"] == "new"
