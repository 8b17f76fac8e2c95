"""Reports as lines of text."""

from provenir.operators import reports


def text(df):
    return [r["line"] for r in df.orderBy("ord").collect()]


def test_counts_are_aligned_under_their_heads(spark):
    rows = spark.createDataFrame([(1, 0, "nodes", None), (1, 1, "total", 1200), (2, 0, "edges", None), (2, 1, "of type AUTHORED", 7)], "part int, place long, label string, n long")
    assert text(reports.aligned(rows)) == ["", "nodes", "total             1200", "", "edges", "of type AUTHORED     7"]


def test_found_and_missing_are_counted_by_the_pass_that_reads_the_list(spark):
    known, nodes = spark.createDataFrame([("Q1",), ("Q1",), ("Q2",), ("Q3",)], "qid string"), spark.createDataFrame([("Q1",), ("Q3",)], "qid string")
    held, seen = reports.watch_known(known, nodes)
    assert sorted(r["qid"] for r in held.collect()) == ["Q1", "Q3"] and seen.get == {"found": 2, "missing": 1}


def test_recommendations(spark):
    nodes = spark.createDataFrame([("Q1", "PERSON", "Ann"), ("Q2", "WORK", "Bo"), ("Q3", "PERSON", "Cy")], "qid string, kind string, label string")
    head = spark.createDataFrame([(1, "Q3", 7, 0.25, 1, 2)], "rank int, candidate string, degree long, score double, known_reached long, intermediates long")
    routes = spark.createDataFrame([("Q3", 1, "Q1", "Q2"), ("Q3", 2, "Q1", "Q404")], "candidate string, k int, seed string, best_via string")
    assert text(reports.recommendation_report(nodes, head, routes, 9, 3, 1, "raw", 5)) == [
        "# 1 of 9 candidates, from 3 known entities (1 of the list not in the graph)", "# scored by raw; at least 5 edges",
        "  1. 0.2500  Cy (Q3), PERSON: 7 edges, 1 known over 2 between", "      from Ann (Q1) over Bo (Q2)", "      from Ann (Q1) over Q404 (Q404)",
    ]
    assert text(reports.recommendation_report(nodes, head.limit(0), routes, 0, 3, 0, "raw", 5))[-1] == "# nothing found"


def test_summaries(spark):
    seeds = spark.range(5)
    resolved = spark.createDataFrame([("ACCEPTED",), ("ACCEPTED",), ("REVIEW",)], "status string")
    assert text(reports.seed_summary(seeds, resolved, 1)) == ["rows: 5, names after folding: 4", "answered by an earlier run: 1", "resolved in this run: 3", "  accepted:   2 (67%)", "  to review:  1 (33%)", "  not found:  0 (0%)"]
    assert text(reports.seed_summary(seeds, resolved.limit(0)))[-1] == "  not found:  0"
    signals = spark.createDataFrame([("Q1", "resolved"), ("Q1", "resolved"), ("Q001", "resolved"), (None, "in_review"), (None, "unanswered")], "qid string, outcome string")
    assert text(reports.signals_summary(signals)) == ["5 rows", "2 resolved", "1 resolved to local entities", "1 left for review", "1 not answered", "2 entities with a signal"]
    counts = spark.createDataFrame([("wikidata", "kept", 12), ("", "unknown entity", 1)], "source_id string, fate string, n long")
    assert text(reports.expansion_report(counts)) == ["", "expansion", "seeds: unknown entity   1", "wikidata: kept         12"]
