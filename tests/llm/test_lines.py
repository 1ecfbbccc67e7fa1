"""Line deduplication against brute force, under several batches and levels."""

from __future__ import annotations

import os
import random

import pytest
from pyspark.sql import functions as F

from levelbook.llm import lines
from levelbook.llm.frames import shared_dir

from .helpers import docs_of

BLANK = " \t\n\x0b\f\r"


def brute(rows, min_length=40, min_documents=5):
    """(id, lines, dropped, kept) per row; a NULL id is less than all."""
    def key(line):
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(BLANK))

    def order(i):
        return (i is not None, i or 0)

    holders = {}
    for i, text in rows:
        for line in (text or "").split("\n"):
            holders.setdefault(key(line), set()).add(i)
    out = []
    for i, text in rows:
        own = (text or "").split("\n")
        kept = [
            line for line in own
            if len(k := key(line)) < min_length or len(holders[k]) < min_documents or max(holders[k], key=order) == i
        ]
        out.append((i, len(own), len(own) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def dropped(df, **options):
    return sorted((tuple(r) for r in lines.drop_lines(df, **options).collect()), key=str)


def texts(seed=0, n=60):
    rng = random.Random(seed)
    pool = [f"line {k} of the pool " + "abc éü " * 6 for k in range(25)] + ["short", "", "  "]
    out = []
    for i in range(n):
        own = [rng.choice(pool) for _ in range(rng.randint(0, 12))] + [f"own line of {i} " + "x" * 40]
        own = [rng.choice(["", " ", "\t", "\x0b"]) + (x.upper() if rng.random() < 0.2 and "é" not in x else x) + rng.choice(["", "\r", " "]) for x in own]
        out.append("\n".join(own))
    return out


@pytest.mark.parametrize("options", [{}, {"batches": 1, "hot_share": 4}, {"batches": 7, "fan": 3, "hot_share": 1}])
def test_against_brute_force(spark, options):
    rows = list(enumerate(texts()))
    random.Random(1).shuffle(rows)
    assert dropped(docs_of(spark, rows), **options) == brute(rows)


def test_odd_rows(spark):
    line = "the very same line in all of these documents, long enough"
    rows = [(i, line + "\n" + str(i)) for i in range(4)]
    assert dropped(docs_of(spark, rows)) == brute(rows)  # four documents are too few
    rows += [(None, line), (None, line + "\n\n" + line), (7, None), (8, ""), (9, "\n"), (3, line), (3, line + "\nother"), (2, "\n" + line)]
    found = dropped(docs_of(spark, rows))
    assert found == brute(rows)
    assert [x for x in found if x[0] == 3 and x[2]] == []
    assert sum(x[2] for x in found) == 7


def test_edges_of_the_rule(spark):
    forty, less = "é" * 40, "é" * 39
    rows = [(i, f"{forty}\n {less} \n {less}") for i in range(5)]
    found = dropped(docs_of(spark, rows))
    assert found == brute(rows)
    assert [x[2] for x in found] == [2, 2, 2, 2, 0]  # a blank that is not stripped makes a line of 40


def test_long_text_and_one_hot_line(spark):
    hot = "a line that nearly every document of the table holds"
    rows = [(i, f"{hot}\nrow {i}") for i in range(300)] + [(1000, "\n".join([hot, *(f"long document, line number {k:07d}, unlike others" for k in range(20000)), hot]))]
    rows.append((999, rows[-1][1]))
    rows += [(2000 + i, rows[300][1][:200000]) for i in range(4)]
    assert dropped(docs_of(spark, rows)) == brute(rows)


def test_empty_table_and_clashing_names(spark):
    assert dropped(docs_of(spark, [])) == []
    assert dropped(docs_of(spark, [None])) == [(1, 1, 0, "")]
    rows = list(enumerate(texts(3, 20)))
    df = docs_of(spark, [(i, t) for i, t in rows]).withColumns(
        {c: F.lit(1) for c in ("doc", "_doc", "pos", "h1", "h2", "n", "owner", "total", "dropped", "text_key", "_text_key", "_bucket", "kept")}
    )
    assert dropped(df) == brute(rows)


def test_runs_hold_every_key_once_and_are_compacted(spark):
    df = docs_of(spark, list(enumerate(texts(5, 40)))).withColumn("text_key", F.xxhash64("text"))
    found = lines.line_hashes(df).persist()
    runs = lines.LineRuns(spark, buckets=3)
    levels = []
    for lo in (30, 20, 10, 0):
        runs.add(lines.batch_keys(found.filter((F.col("doc") >= lo) & (F.col("doc") < lo + 10))))
        levels.append([run.level for run in runs.runs])
    assert levels == [[0], [1], [1, 0], [2]]
    rows = runs.runs[0].rows.collect()
    distinct = found.groupBy("h1", "h2").agg(F.max("doc").alias("owner"), F.count_distinct("doc").alias("n"))
    assert {(r.h1, r.h2, r.owner) for r in rows} == {(r.h1, r.h2, r.owner) for r in distinct.collect()}
    assert len(rows) == distinct.count()
    assert {(r.h1, r.h2, r.total) for r in runs.repeated(2).collect()} == {(r.h1, r.h2, r.n) for r in distinct.collect() if r.n >= 2}
    # Merging a run needs no shuffle of it.
    plan = runs.runs[0].rows.join(runs.runs[0].rows.select("h1", "h2").hint("merge"), ["h1", "h2"], "left_anti")
    assert "Exchange" not in plan._jdf.queryExecution().executedPlan().toString()
    runs.drop()
    found.unpersist()


def test_plan_is_native_and_tables_go(spark):
    folder = shared_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    df = lines.drop_lines(docs_of(spark, list(enumerate(texts()))))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas", "CartesianProduct", "NestedLoop"))
    df.collect()
    assert [name[:18] for name in set(os.listdir(folder)) - before] == ["llm-dropped-lines-"]
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("levelbook_lines")]
