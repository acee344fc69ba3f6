import numpy as np

from lotline.llm import outliers
from tests.llm.data import SCHEMA, documents, texts, with_odd_columns


def brute(text):
    tokens = [w for w in "".join(c if c not in " \t\n\x0b\x0c\r" else " " for c in text or "").split(" ") if w]
    windows = [tuple(tokens[i : i + 8]) for i in range(len(tokens) - 7)]
    covered = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 8)}
    lines = [line for line in (text or "").split("\n") if line.strip(" \t\x0b\x0c\r")]
    return (
        len(tokens),
        sum(map(len, tokens)),
        sum(c in "#*$%&|<>" for c in text or ""),
        sum(line in lines[:i] for i, line in enumerate(lines)),
        len(covered),
    )


def test_statistics():
    loop = " ".join("abcdefghij")
    for text in [*texts(3, 60, 60)[:6], *texts(3, 60, 60)[7:], f"{loop} x {loop}", "a\na\n \n b\n b", "#*$ é|< >", "a " * 30, "\x1c\x85 x"]:
        assert outliers.statistics(text) == brute(text), text


def test_chi_square():
    # Known quantiles.
    assert abs(outliers.chi2_quantile(0.975, 5) - 12.8325) < 1e-3
    assert abs(outliers.chi2_quantile(0.95, 7) - 14.0671) < 1e-3


def test_clean_rows_stay_and_junk_goes(spark):
    rng = np.random.default_rng(1)
    clean = [" ".join(rng.choice(["so", "many", "words", "of", "prose", "in", "plain"], int(n)) + rng.choice(["", "s", "ing"], int(n))) for n in rng.integers(60, 300, 400)]
    junk = [" ".join(f"{w}$%" for w in t.split()) for t in clean[:20]]
    few = ["too few words", None, "", *["again and again it says the same thing here " * 6] * 2]
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(clean + junk + few)]
    got = {r.doc_id: r for r in outliers.judge(with_odd_columns(spark.createDataFrame(rows, SCHEMA))).collect()}
    assert len(got) == len(rows)
    assert sum(not got[i].kept for i in range(400)) <= 4
    assert not any(got[i].kept for i in range(400, 420))
    assert all(got[i].base_failed and not got[i].kept and got[i].distance is None for i in range(420, 425))


def vectors(spark, groups):
    rows = [(g, *map(int, np.round(v * outliers._UNIT))) for g, values in groups.items() for v in values]
    return spark.createDataFrame(rows, "g string, " + ", ".join(f"{x} bigint" for x in outliers._X))


def brute_determinant(values, tries=300):
    """The smallest determinant over many random starts, each concentrated to the end; covariances as the operator's."""
    rng = np.random.default_rng(0)
    h, floors, best = int(np.ceil(len(values) * outliers.H_SHARE)), np.diag(np.square(list(outliers.FLOORS.values()))), np.inf
    factor = outliers._consistency(outliers.H_SHARE)
    for _ in range(tries):
        chosen = rng.choice(len(values), 6, replace=False)
        for _ in range(50):
            mean = values[chosen].mean(axis=0)
            cov = np.cov(values[chosen].T, bias=True) * factor + floors
            nearest = np.argsort(np.einsum("ij,jk,ik->i", values - mean, np.linalg.inv(cov), values - mean), kind="stable")[:h]
            if set(nearest) == set(chosen):
                break
            chosen = nearest
        best = min(best, np.linalg.slogdet(np.cov(values[chosen].T, bias=True) * factor + floors)[1])
    return best


def test_the_smallest_determinant_is_found(spark):
    """Groups with a fifth of their rows far away, in a heap or along a line that medians alone do not tell apart."""
    rng = np.random.default_rng(4)
    turn = rng.standard_normal((5, 5))
    clean = lambda n: 5 + rng.standard_normal((n, 5)) @ turn
    groups = {"heap": np.vstack([clean(160), 5 + np.array([9.0, -7, 8, 6, -9]) + 0.1 * rng.standard_normal((40, 5))])}
    groups["line"] = np.vstack([clean(240), 5 + rng.uniform(-30, 30, (60, 1)) * np.array([[1.0, 1, -1, 1, 1]])])
    groups["plain"] = clean(120)
    groups["few"] = clean(20)
    found = {r.g: r for r in outliers.estimates(vectors(spark, groups)).collect()}
    assert found.keys() == {"heap", "line", "plain"}
    for g, r in found.items():
        values = np.round(groups[g] * outliers._UNIT) / outliers._UNIT
        # Bins of distance take a few rows more than the share.
        assert r["size"] < brute_determinant(values) + 0.35, g


def test_one_odd_statistic_is_enough(spark):
    rng = np.random.default_rng(2)
    prose = lambda n: " ".join(f"{w}{rng.integers(10**6)}" for w in rng.choice(["so", "many", "words", "of"], n))
    clean = [prose(int(n)) for n in rng.integers(80, 200, 300)]
    body, loop = prose(150), prose(20)
    odd = {
        "symbols": " ".join(w + ("#" if i % 8 == 0 else "") for i, w in enumerate(clean[0].split())),
        "lines": "\n".join([*clean[1].split(" "), *(["- -"] * 12)]),
        "repeats": f"{loop} {body} {loop}",
    }
    once = {"one sign": clean[4] + " #", "one line": clean[5] + "\nover again\nx\nover again"}
    rows = [(i, t, "en", "s", 0) for i, t in enumerate([*clean, *odd.values(), *once.values()])]
    got = {r.doc_id: r for r in outliers.judge(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert [got[300 + k].kept for k in range(5)] == [False, False, False, True, True]
    assert not any(got[300 + k].base_failed for k in range(5)) and sum(not got[i].kept for i in range(300)) <= 3


def test_small_groups_are_judged_by_their_language_and_then_by_all(spark):
    rng = np.random.default_rng(3)
    prose = lambda n: " ".join(rng.choice(["so", "many", "words", "of", "prose"], n) + rng.choice(["", "s", "ing"], n))
    rows = [(i, prose(int(n)), "en", "big", 0) for i, n in enumerate(rng.integers(60, 200, 200))]
    junk = "  ".join(f"{w}$%#" for w in prose(90).split())
    rows += [(1000, junk, "en", "rare", 0), (1001, prose(90), "en", "rare", 0), (1002, junk, "fr", "x", 0), (1003, prose(90), "fr", None, 0)]
    got = {r.doc_id: r for r in outliers.judge(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert [got[i].kept for i in (1000, 1001, 1002, 1003)] == [False, True, False, True]
    assert all(got[i].distance is not None for i in (1000, 1001, 1002, 1003))


def test_small_groups_and_odd_rows(spark):
    rows = documents(spark, texts(5, 30))
    got = outliers.judge(rows.union(rows.selectExpr("CAST(NULL AS bigint)", "text", "lang", "CAST(NULL AS string)", "n_chars"))).collect()
    assert len(got) == 60
    # The whole table has too few rows for an estimate.
    assert all(r.kept == (not r.base_failed) for r in got)
    assert outliers.judge(rows.limit(0)).collect() == []
