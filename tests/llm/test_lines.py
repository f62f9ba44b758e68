import tempfile
from collections import Counter

import pytest
from llm_helpers import awkward_texts, frame, same, sha

from shelfwise.llm import line_runs as L

LOWER = str.maketrans(L.UPPER, L.LOWER)


def line_dedup(rows, least=10, chars=1):
    """Operator 13 by a count of all keys."""
    key = lambda line: line.strip(L.BLANKS).translate(LOWER)
    split = [(t or "").split("\n") for _, t in rows]
    count = Counter(k for lines in split for k in {key(x) for x in lines} if len(k) >= chars)
    out = []
    for (d, _), lines in zip(rows, split):
        kept = [x for x in lines if count[key(x)] < least]
        out.append((d, len(lines), len(lines) - len(kept), sha("\n".join(kept).encode())))
    return out


def digests(df, **more):
    from pyspark.sql import functions as F

    out = L.drop_common_lines(df, **more)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256)).collect()


def awkward_rows():
    texts = awkward_texts()
    texts += ["\n", "\n\n\n", "A line\n a LINE\t\nother", "a line", "\x0bA line\x0c\r", "É line\né line", "a line ", "\x1ca line", "x\n" * 3000]
    ids = [7 * k % 101 for k in range(len(texts))]
    ids[3] = ids[10] = None
    rows = list(zip(ids, texts))
    return rows + [rows[7], rows[7], (rows[11][0], "other text\na line"), (None, "same"), (None, "same"), (None, None), (None, "")]


@pytest.mark.parametrize("least,chars,batches", [(3, 1, 1), (3, 1, 6), (2, 4, 3), (1, 0, 2)])
def test_lines_match_brute_force(spark, least, chars, batches):
    rows = awkward_rows()
    got = digests(frame(spark, [t for _, t in rows], [d for d, _ in rows]), least_docs=least, least_chars=chars, batches=batches)
    same(got, line_dedup(rows, least, chars))


def test_kept_text_and_repeats_within_a_document(spark):
    rows = [(1, "Cookies\nfirst"), (2, "  cookies \nsecond\n"), (3, "third\nthird\nthird")]
    got = {r.doc_id: r for r in L.drop_common_lines(frame(spark, [t for _, t in rows], [1, 2, 3]), least_docs=2, batches=2).collect()}
    assert [got[k].text for k in (1, 2, 3)] == ["first", "second\n", "third\nthird\nthird"]
    assert (got[2].n_lines, got[2].n_dropped) == (3, 1)


def test_empty_table(spark):
    assert digests(frame(spark, [])) == []


def test_runs_are_levelled_and_survive_broken_merges(spark):
    runs = L.LineRuns(spark, tempfile.mkdtemp() + "/runs", fan=2)
    assert runs.runs() == [] and runs.found_in(1).count() == 0
    for k in range(5):
        runs.add(frame(spark, ["shared\nown %d" % k], [k], clashing=False))
    assert runs.runs() == [(0, 3), (4, 4)]
    assert runs.found_in(5).count() == 1 and runs.found_in(1).count() == 6
    runs._write(runs._merged([(4, 4)]), (4, 4))                   # a run left by a driver that was lost before it deleted it
    runs._write(runs._merged([(0, 3)]), (0, 1))
    assert runs.runs() == [(0, 3), (4, 4)] and runs.found_in(5).count() == 1


def test_a_new_batch_is_joined_with_all_earlier_ones(spark):
    runs = L.LineRuns(spark, tempfile.mkdtemp() + "/runs", fan=3)
    for k in range(4):
        batch = frame(spark, ["menu\ntext %d" % k], [k], clashing=False)
        runs.add(batch)
        kept = L.without_lines(batch, runs.found_in(3)).first().text
        assert kept == ("text %d" % k if k >= 2 else "menu\ntext %d" % k)


def test_no_python_in_the_plan(spark):
    docs = frame(spark, ["a\nb", "a"], clashing=False)
    runs = L.LineRuns(spark, tempfile.mkdtemp() + "/runs")
    runs.add(docs)
    plan = L.without_lines(docs, runs.found_in(2))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Arrow", "Python", "Pandas", "CartesianProduct", "BroadcastNestedLoopJoin"))
