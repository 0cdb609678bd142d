import re

import numpy as np
from pyspark.ml.feature import HashingTF

from scopelake.llm import urls


def brute(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split("[/?#]", rest, maxsplit=1)[0]
        path = re.split("[?#]", rest[len(host) :], maxsplit=1)[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    best = None
    for verdict, h, p in urls.RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = (h + p, verdict)
    return host, path, best


URLS = [None, "", "no scheme/en/1", "http://", "HTTP://ExAmple.COM/en/7?x#y", "https://a.example.com/en/71", "https://b.example.com/en/81", "x://notexample.com/en/7", "http://net/de/8", "http://example.net/de/8", "http://example.net/de/9", "http://a.org/es/", "http://a.org/es", "http://a.b?c://d/e", "http://a\nb.com/en/\nq", "://com/en/", "http://u@h:80/p/q#f", "ftp://ÀB.org/es/é?", "http://" + "a" * 5000 + ".com/en/" + "b" * 20000]


def test_parts_and_rules(spark):
    pages = spark.createDataFrame([(i, u, None, "x") for i, u in enumerate(URLS + URLS[:3])], "page_id long, url string, html string, host string")
    rows = {r.page_id: r for r in urls.judge(pages, urls.fit(urls.labelled_urls(spark))).collect()}
    assert len(rows) == len(URLS) + 3
    for i, u in enumerate(URLS + URLS[:3]):
        host, path, best = brute(u)
        r = rows[i]
        assert (r.host, r.path, r.rule) == (host, path, best and best[0]), u
        assert r.verdict == (best[1] if best else ("block" if r.score >= 0.5 else "allow")) and 0 <= r.score <= 1


def test_model_learns_and_holds_out(spark):
    rows = urls.labelled_urls(spark)
    assert rows.count() <= 200
    right = 0
    for k in range(4):
        train, test = rows.filter(f"pmod(xxhash64(url), 4) <> {k}"), rows.filter(f"pmod(xxhash64(url), 4) = {k}")
        right += urls.fit(train).score(urls.with_parts(test)).filter("(score >= 0.5) = (label = 1)").count()
    assert right / rows.count() > 0.78
    unseen = spark.createDataFrame([("http://blog.cheap-pills.example.net/en/1", 1), ("http://casino-win.example.org/fr/2", 1), ("http://www.thinge.example.org/fr/2", 0), ("http://m.riverside.example.com/de/3", 0)], "url string, label int")
    assert all((r.score >= 0.5) == (r.label == 1) for r in urls.fit(rows).score(urls.with_parts(unseen)).collect())


def plain_grams(host, path):
    return [mark + whole[i : i + n] for mark, whole in (("h", f"^{host}$"), ("p", f"^{path}$")) for n in urls.NGRAMS for i in range(len(whole) - n + 1)]


def test_scores_against_a_plain_regression(spark):
    """Features and scores computed plainly, and the fitted weights are where the penalised loss is flat."""
    tf = HashingTF(numFeatures=urls.BUCKETS, binary=True)
    rows = [(r.url, r.label) for r in urls.labelled_urls(spark).collect()]
    model = urls.fit(urls.labelled_urls(spark))
    weights, bias = model.stages.stages[1].coefficients.toArray(), model.stages.stages[1].intercept

    def features(url):
        host, path, _ = brute(url)
        x = np.zeros(urls.BUCKETS)
        x[[tf.indexOf(g) for g in plain_grams(host, path)]] = 1
        return x

    some = [(i, u) for i, u in enumerate([u for u, _ in rows[:20]] + ["http://m.unseen.example.org/en/7", None, "x"])]
    got = {r.page_id: r.score for r in urls.judge(spark.createDataFrame(some, "page_id long, url string"), model).collect()}
    for i, u in some:
        assert abs(got[i] - 1 / (1 + np.exp(-(features(u) @ weights + bias)))) < 1e-9, u
    x, y = np.array([features(u) for u, _ in rows]), np.array([label for _, label in rows])
    p = 1 / (1 + np.exp(-(x @ weights + bias)))
    slope = x.T @ (p - y) / len(y) + 1e-2 * weights
    assert np.abs(slope).max() < 1e-3 and abs((p - y).mean()) < 1e-3


def test_empty(spark):
    model = urls.fit(urls.labelled_urls(spark))
    assert urls.judge(spark.createDataFrame([], "page_id long, url string"), model).count() == 0


def test_plan_has_no_python(spark):
    pages = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string").repartition(2)
    plan = urls.judge(pages, urls.fit(urls.labelled_urls(spark)))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
