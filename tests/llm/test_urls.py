import math
import random
from collections import Counter, defaultdict

from llm_helpers import same

from shelfwise.llm import url_filter as U

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def pages(spark, urls, ids=None):
    rows = [(i, u, "clash", "clash") for i, u in zip(ids or range(len(urls)), urls)]
    return spark.createDataFrame(rows, "page_id long, url string, host string, text string")


def test_parts_and_rules(spark):
    cases = {
        None: ("", "", None), "": ("", "", None), "example.net/en/": ("", "", None),
        "http://A.Example.NET/en/x?q#f": ("a.example.net", "/en/x", "example.net/en/"), "http://example.net/EN/": ("example.net", "/EN/", "net/"),
        "https://x.net?y/z": ("x.net", "", None), "https://notexample.com/de/": ("notexample.com", "/de/", None), "x://example.com/de/a://b": ("example.com", "/de/a://b", "example.com/de/"),
        "ftp://q.org/fr/": ("q.org", "/fr/", "org/fr/"), "://net/": ("net", "/", "net/"), "http://É.org/fr/\n?x": ("É.org", "/fr/\n", "org/fr/"), "http://net#/": ("net", "", None),
    }
    got = U.filter_urls(pages(spark, list(cases)), RULES).collect()
    same([(r.page_id, r.host, r.path, r.rule) for r in got], [(k, *v) for k, v in enumerate(cases.values())])
    verdicts = {(h + p): v for h, p, v in RULES}
    assert all(r.verdict == verdicts[r.rule] for r in got if r.rule)


def by_hand(texts, context=U.CONTEXT):
    """(good, bad) texts' models as plain counts; the mean log ratio of a text."""
    def model(kind):
        n, kinds = Counter(), defaultdict(set)
        for t, (good, bad) in texts.items():
            s = "\u0002" + t + "\u0003"
            for i in range(1, len(s)):
                for k in range(min(i, context) + 1):
                    c = (good, bad)[kind]
                    if c:
                        n[s[i - k:i], s[i]] += c
                        n[s[i - k:i]] += c
                        kinds[s[i - k:i]].add(s[i])
        return n, kinds

    models = [model(0), model(1)]

    def p(m, s, i):
        n, kinds = m
        out = 1.0 / U.ALPHABET
        for k in range(min(i, context) + 1):
            c = s[i - k:i]
            if n[c]:
                out = (n[c, s[i]] + len(kinds[c]) * out) / (n[c] + len(kinds[c]))
        return out

    def score(t):
        s = "\u0002" + t + "\u0003"
        return sum(math.log(p(models[0], s, i)) - math.log(p(models[1], s, i)) for i in range(1, len(s))) / (len(s) - 1)

    return score


def test_scores_as_by_hand(spark):
    rng = random.Random(2)
    texts = {"".join(rng.choice("abc./é🙂") for _ in range(rng.randint(0, 30))): (rng.randint(0, 2), rng.randint(0, 2)) for _ in range(40)}
    rows = [(k, t, g, b, True) for k, (t, (g, b)) in enumerate(texts.items())]
    got = {rows[r.id][1]: r.score for r in U.scores(spark.createDataFrame(rows, "id long, text string, good long, bad long, wanted boolean")).collect()}
    score = by_hand(texts)
    assert set(got) == set(texts)
    assert all(abs(got[t] / U.UNIT - score(t)) < 1e-6 for t in texts)


def test_models_tell_kinds_apart(spark):
    rng = random.Random(5)
    good = [f"http://{rng.choice(['news', 'wiki'])}{rng.randint(0, 99)}.org/fr/{rng.randint(0, 999)}" for _ in range(150)]
    bad = [f"http://{rng.choice(['casino', 'bets'])}{rng.randint(0, 99)}.net/x/{rng.randint(0, 999)}" for _ in range(150)]
    open_ = [("http://wiki5.org/en/17", "allow"), ("http://casino7.com/x/5", "block")]
    urls = good + bad + [u for u, _ in open_]
    got = {r.page_id: r.verdict for r in U.filter_urls(pages(spark, urls), RULES).collect()}
    assert [got[len(good) + len(bad) + k] for k in range(2)] == [v for _, v in open_]


def test_rows_stay_and_edges(spark):
    assert U.filter_urls(pages(spark, [], []), RULES).count() == 0
    long = "http://x.com/" + "a/b" * 20000
    got = U.filter_urls(pages(spark, [long, None, None, long], [1, None, 2, 1]), RULES)
    same([(r.page_id, r.verdict) for r in got.collect()], [(1, "allow"), (None, "allow"), (2, "allow"), (1, "allow")])


def test_main_path_has_no_python(spark):
    plan = U.filter_urls(pages(spark, ["http://a.org/fr/", "http://b.net/"]), RULES)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_no_written_table_is_broadcast(spark, monkeypatch):
    """every join of the main path is by sort and merge, however small the tables' files are."""
    plans, write = [], U.stored

    def written(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, name)

    monkeypatch.setattr(U, "stored", written)
    found = U.filter_urls(pages(spark, ["http://a.org/fr/", "http://b.net/", "http://c.com/x"]), RULES)
    bound = U.calibrated
    monkeypatch.setattr(U, "calibrated", lambda examples: plans.append(examples._jdf.queryExecution().executedPlan().toString()) or bound(examples))
    U.filter_urls(pages(spark, ["http://a.org/fr/", "http://b.net/", "http://c.com/x"]), RULES)
    found.collect()
    plans.append(found._jdf.queryExecution().executedPlan().toString())
    assert sum("SortMergeJoin" in p for p in plans) > 4 and not any("Broadcast" in p for p in plans)
