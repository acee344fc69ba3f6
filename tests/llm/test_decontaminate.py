import random
from itertools import combinations

from pyspark.sql import functions as F

from lotline.llm import decontaminate
from tests.llm.data import documents, texts, with_odd_columns


def test_masks_find_every_overlap():
    places = [frozenset(s + o for o in mask) for mask in decontaminate.MASKS for s in range(decontaminate.WINDOW - mask[-1])]
    for gone in combinations(range(decontaminate.WINDOW), decontaminate.SUBSTITUTED):
        assert any(not p & set(gone) for p in places), gone
    for n in range(1, decontaminate.WINDOW):
        allowed = n * decontaminate.SUBSTITUTED // decontaminate.WINDOW
        (mask,) = decontaminate.short_masks([n])
        for gone in combinations(range(n), allowed):
            assert any(not set(range(s, s + len(mask))) & set(gone) for s in range(n - len(mask) + 1))


def plain(text):
    out = "".join(" " if c in "\t\n\x0b\x0c\r" else "" if c in decontaminate._PUNCTUATION else c for c in (text or "").lower())
    return [w for w in out.split(" ") if w]


def brute(docs, items):
    """Document and item that share a stretch, with the most equal words."""
    out = {}
    for d, text in docs.items():
        a = plain(text)
        for k, item in items.items():
            b = plain(item)
            n = min(13, len(b))
            for i in range(len(a) - n + 1) if n else ():
                for j in range(len(b) - n + 1):
                    equal = sum(x == y for x, y in zip(a[i : i + n], b[j : j + n], strict=True))
                    if equal >= n - n * 2 // 13:
                        out[d, k] = max(out.get((d, k), 0), equal)
    return out


def test_overlaps(spark):
    rng = random.Random(8)
    fresh = lambda n: [f"{rng.choice('bcdfg')}{rng.randrange(500)}" for _ in range(n)]
    items = {0: fresh(40), 1: fresh(15), 2: fresh(13), 3: fresh(7), 4: fresh(4), 5: fresh(1), 6: fresh(60)}
    items[7] = items[6][:]
    values = [None, "", *texts(9, 25, 60)[7:]]
    for k, item in items.items():
        for changed in range(4):
            words = item[:]
            for p in rng.sample(range(len(words)), min(changed, len(words))):
                words[p] = "other"
            values.append(" ".join([*fresh(5), *words, *fresh(5)]))
            values.append(" ".join(words).upper() + ".")
            cut = words[: rng.randint(1, len(words))]
            values.append("\n".join(cut + fresh(3)))
    docs = documents(spark, values)
    tests = {k: ", ".join(v) for k, v in items.items()} | {8: None, 9: " . "}
    bench = spark.createDataFrame([(k, t, "odd") for k, t in tests.items()], "item_id bigint, text string, doc_id string")
    got = decontaminate.overlaps(with_odd_columns(docs), bench.union(bench.limit(2))).collect()
    want = brute(dict(enumerate(values)), {k: t for k, t in tests.items() if k != 7})
    assert {(r.doc_id, r.item_id): r.n_equal for r in got} == want and len(got) == len(want)
    assert len(want) > 40
    assert all(r.item_ids == ([6, 7] if r.item_id == 6 else [r.item_id]) for r in got)
    for r in got:
        a, b = plain(values[r.doc_id]), plain(tests[r.item_id])
        pairs = zip(a[r.doc_start : r.doc_start + r.n_words], b[r.item_start : r.item_start + r.n_words], strict=True)
        assert sum(x == y for x, y in pairs) == r.n_equal


def test_large_benchmarks_are_not_broadcast(spark, monkeypatch):
    docs, bench = documents(spark, texts(9, 30)), spark.createDataFrame([(1, texts(9, 30)[6][:200])], "item_id bigint, text string")
    small = sorted(map(tuple, decontaminate.overlaps(docs, bench).collect()))
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", 0)
    assert sorted(map(tuple, decontaminate.overlaps(docs, bench).collect())) == small != []


def test_empty_tables_and_native(spark):
    docs, bench = documents(spark, ["a b"]), spark.createDataFrame([(1, "a b")], "item_id bigint, text string")
    assert decontaminate.overlaps(docs.limit(0), bench).collect() == []
    assert decontaminate.overlaps(docs, bench.limit(0)).collect() == []
    found = decontaminate.overlaps(docs.selectExpr("CAST(NULL AS bigint) AS doc_id", "text"), bench)
    assert [r.doc_id for r in found.collect()] == [None]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_a_benchmark_of_200_000_seeds(spark):
    """The table grows with the seeds: few places of random words get past it, and all planted ones are found."""
    rng = random.Random(3)
    items = [[f"{rng.randrange(10**6)}" for _ in range(60)] for _ in range(2000)]
    n = sum(len(item) - mask[-1] for item in items for mask in decontaminate.MASKS)
    assert n > 200_000 and decontaminate.table_words(n) > decontaminate.LEAST_TABLE_WORDS
    bench = spark.createDataFrame([(k, " ".join(item)) for k, item in enumerate(items)], "item_id bigint, text string")
    values = [" ".join(f"{rng.randrange(10**6)}" for _ in range(400)) for _ in range(60)] + [" ".join(["x", *items[k][10:30], "y"]) for k in range(40)]
    docs = documents(spark, values)
    got = {(r.doc_id, r.item_id) for r in decontaminate.overlaps(docs, bench).collect()}
    assert got == {(60 + k, k) for k in range(40)}

    held = bench.select(decontaminate.word_hashes(bench.text).alias("h"), "item_id")
    words = decontaminate.table_words(n)
    table = decontaminate._table(decontaminate._seeds(held, list(decontaminate.MASKS)), words)
    hashes = docs.where("doc_id < 60").select(decontaminate.word_hashes(docs.text).alias("h"))
    passed = hashes.selectExpr("h").select(*[F.size(decontaminate._hits(F.col("h"), k, m, table, words)).alias(f"n{k}") for k, m in enumerate(decontaminate.MASKS)])
    assert passed.agg(F.sum("n0") + F.sum("n1")).first()[0] < 0.02 * 60 * 2 * 395
    assert decontaminate.table_words(10**9) == decontaminate.MOST_TABLE_WORDS


def test_plans_do_not_spell_out_the_table(spark):
    """Each of Spark's updates of a running plan has its text; the table of 16,384 numbers was in it many times."""
    docs, bench = documents(spark, texts(9, 30)), spark.createDataFrame([(k, t) for k, t in enumerate(texts(9, 30))], "item_id bigint, text string")
    found = decontaminate.overlaps(docs, bench)
    assert len(found._jdf.queryExecution().toString()) < 500_000
    # The subquery is where the table is used; no row of a document carries it.
    plan = found._jdf.queryExecution().optimizedPlan()
    assert "scalar-subquery" in plan.toString() and " AS table#" not in plan.toString()
    assert found.count() > 0
