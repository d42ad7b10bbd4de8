"""Stored symbols: only new and changed files are parsed."""

from pyspark.sql import functions as F

from lorekeep.operators import code
from lorekeep.operators.symbolstore import SymbolStore, folder_hashes, repository_hashes, _placed

FILES = "repo string, commit_sha string, file_path string, text string"


def tree(spark, change=()):
    rows = [(f"r{i % 2}", "c1", f"src/d{i % 10}/f{i}.py" if i % 3 else f"f{i}.js", f"def f{i}():\n    return {i}\n" if i % 3 else f"function f{i}() {{\n return {i}\n}}") for i in range(400)]
    rows = [(r, c, p, t.replace("return", "return 1 +") if i in change else t) for i, (r, c, p, t) in enumerate(rows)]
    return spark.createDataFrame([*rows, ("r0", "c1", "node_modules/x.js", "function x() {}"), ("r0", "c1", "src/empty.py", None), ("r1", "c1", "src/odd.py", "def (")], FILES)


def rows(df):
    return sorted(map(repr, map(tuple, df.select("repo", "file_path", "symbol", "content_hash", "line_start", "line_end").collect())))


def test_a_hundredth_of_the_files_is_parsed(spark, tmp_path):
    s, sc = SymbolStore(spark, str(tmp_path / "symbols")), spark.sparkContext
    first, second, third = sc.accumulator(0), sc.accumulator(0), sc.accumulator(0)
    s.create(tree(spark), 16, first)
    assert rows(s.symbols()) == rows(code.extract_symbols(tree(spark))) and first.value == 402
    now = tree(spark, (7, 8, 60)).where("file_path <> 'f9.js'").union(spark.createDataFrame([("r1", "c2", "new/n.py", "def n(): pass")], FILES))
    assert s.changes(now)[1].count() == 1
    s.update(now, second)
    assert second.value == 4 and rows(s.symbols()) == rows(code.extract_symbols(now))
    assert s.update(now, third)["version"] == 2 and third.value == 0
    other = spark.createDataFrame([("r9", "c", "a.py", "def a(): pass")], FILES)  # other repositories stay as they are
    s.update(other)
    assert rows(s.symbols()) == rows(code.extract_symbols(now.union(other)))
    s.rows.compact()
    assert rows(s.symbols()) == rows(code.extract_symbols(now.union(other)))


def test_hashes_are_rolled_up(spark):
    a, b = (folder_hashes(_placed(tree(spark, c))) for c in ((), (7,)))
    key = ["repo", "folder"]
    differ = a.join(b.select(*key, F.col("hash").alias("other")), key).where("hash <> other").collect()
    assert [(r.repo, r.folder) for r in differ] == [("r1", "src/d7")]
    one, two = ({r.repo: (r.hash, r.n) for r in repository_hashes(x).collect()} for x in (a, b))
    assert one["r0"] == two["r0"] and one["r1"][0] != two["r1"][0] and sum(n for _, n in one.values()) == 402
