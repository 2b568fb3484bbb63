import itertools
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathomline.functions import names as N
from fathomline.functions import text as X
from fathomline.functions import urls as U
from fathomline.operators import clusters, graph, predicates, resolve, rollup, rounds, scoring, similarity, timeline, windows
from fathomline.plans.registry import queries
from fathomline.sources import feeds, sinks
from fathomline.streaming import ingest


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_names(spark):
    assert one(spark, N.slugify(F.lit("Café Déjà, Inc. LLC"))) == "cafe-deja"
    assert one(spark, N.normalize_name(F.lit("Foo-Bar Holdings"))) == "foobar"
    assert one(spark, N.normalized_round_type(F.lit("Series E Extension"))) == "series e"
    assert one(spark, N.normalized_round_type(F.lit("Extension"))) is None
    assert one(spark, N.format_usd(F.lit(1_500_000.0))) == "$1.5M"
    assert one(spark, N.claim_usd(F.lit(110e6))) == "$110M"
    assert one(spark, N.claim_usd(F.lit(None).cast("double"))) == "an undisclosed amount"
    assert tuple(one(spark, N.employee_range(F.lit("50 to 11")))) == (11, 50)
    assert one(spark, N.employee_range(F.lit("many"))) is None


def test_urls(spark):
    assert one(spark, U.canonical_url(F.lit(" HTTPS://A.com:443/x/?utm_a=1&b=2&ref=z#f"))) == "https://a.com/x?b=2"
    assert one(spark, U.canonical_domain(F.lit("https://me.github.io/"))) is None
    assert one(spark, U.canonical_domain(F.lit("https://www.acme.com/"))) == "acme.com"
    assert one(spark, U.dated_article(F.lit("https://a.com/2024/05/x"))) is True


def test_text(spark):
    src = F.lit("Acme Corp today said it raised $80 million in a round led by Example Ventures and others")
    assert one(spark, X.quote_grounded(F.lit("RAISED  $80 million"), src))
    assert one(spark, X.quote_grounded(F.lit("Acme Corp today ... raised $80 million ... led by Example"), src))
    assert not one(spark, X.quote_grounded(F.lit("raised $80 million ... Acme Corp today"), src))
    assert not one(spark, X.quote_grounded(F.lit(None).cast("string"), src))
    assert X.visible("<title>T</title><style>x</style><p>a <b>b</b><script>no</script>") == "T\na b"
    assert X.balanced('x = {"a": "}", "b": [1]}; y') == '{"a": "}", "b": [1]}'
    assert X.balanced("x = {") is None and X.balanced(None) is None


def test_growth_windows_leave_out_the_running_quarter(spark):
    df = spark.createDataFrame([(1, date(2001, 5, 1), 10.0), (1, date(2001, 8, 1), 99.0), (2, date(2000, 12, 31), 5.0)], "k int, announced_date date, amount_raised double")
    got = {r.k: (r.recent_total, r.prior_total, r.recent_rounds) for r in rollup.two_windows(df, "k", "2001-08-15").collect()}
    assert got == {1: (10.0, None, 1), 2: (None, 5.0, 0)}
    assert len(rollup.fill_quarters(rollup.funding_by_quarter(df, "2001-08-15", 4), "2001-08-15", 4).collect()) == 4


def test_momentum_anchors(spark):
    flat = scoring.news_component(scoring.news_ratio(F.lit(5.0), F.lit(5.0)))
    assert one(spark, flat) == pytest.approx(0.5)
    assert one(spark, scoring.news_component(scoring.news_ratio(F.lit(1e9), F.lit(0.0)))) == pytest.approx(1.0)
    assert one(spark, scoring.combine([(F.lit(None).cast("double"), 0.5)])) is None
    assert one(spark, scoring.combine([(F.lit(0.2), 0.5), (F.lit(None).cast("double"), 0.35)])) == pytest.approx(0.2)
    null = F.lit(None).cast("double")
    assert one(spark, scoring.why(F.lit(4.0), F.lit(2.0), F.lit(8), null)) == ["news +100%", "raised 1wk ago"]


def test_remap_chains_and_cycles(spark):
    m = spark.createDataFrame([(4, 3), (3, 2), (2, 1), (9, 8)], "loser long, survivor long")
    assert {r.loser: r.survivor for r in resolve.resolve_remap(m).collect()} == {4: 1, 3: 1, 2: 1, 9: 8}
    with pytest.raises(ValueError):
        resolve.resolve_remap(spark.createDataFrame([(1, 2), (2, 1)], "loser long, survivor long"))
    with pytest.raises(Exception, match="exactly one"):
        resolve.exactly_one(spark.range(2)).collect()


ROUNDS = "company_id long, id long, amount_raised double, round_type string, announced_date date, confidence string"


def test_near_amounts(spark):
    rows = [(1, 1, 100.0, "Seed", date(2001, 1, 1), "high"), (1, 2, 110.0, None, None, "low"), (1, 3, 120.0, "Series A", date(2001, 1, 2), "low"),
            (2, 4, 100.0, "Seed", None, "low"), (2, 5, 105.0, "Seed", None, "low"), (3, 6, 100.0, "A", date(2001, 1, 1), "high"), (3, 7, 120.0, "A", date(2001, 1, 3), "low")]
    df = spark.createDataFrame(rows, ROUNDS)
    links = spark.createDataFrame([(6, 1), (6, 2), (7, 1), (7, 2)], "round_id long, investor_id long")
    assert {(r.loser, r.survivor) for r in rounds.collapse_near_amounts(df, links).collect()} == {(2, 1), (7, 6)}


def test_reconcile(spark):
    rows = [(1, 1, 5.0, "Seed", date(2001, 1, 1), "low"), (1, 2, None, "seed", date(2001, 2, 1), "low"), (1, 3, 5.0, None, None, "low"), (1, 4, None, None, None, "low"), (1, 5, None, "Seed", date(2001, 9, 1), "low")]
    got = {r.id: (r.round_id, r.created) for r in rounds.reconcile(spark.createDataFrame(rows, ROUNDS)).collect()}
    assert got == {1: (1, True), 2: (1, False), 3: (1, False), 4: (4, True), 5: (5, True)}


def test_stories(spark):
    a, b = spark.createDataFrame([("Acme raises $10bn - Reuters",), ("Acme secures $10 billion | TechDaily",)], "t string").select(timeline.title_words("t"), timeline.title_sums("t")).collect()
    assert set(a[0]) == set(b[0]) and a[1] == b[1] == ["10 billion"]
    rows = [(1, 1, "Acme raises $10bn in Series B - Wire", date(2001, 1, 5)), (1, 2, "Acme secures $10 billion Series B", date(2001, 1, 3)), (1, 3, "Acme raises $2bn in Series B", date(2001, 1, 4)), (1, 4, "Acme raises $10bn in Series B", None), (1, 5, "Acme raises $10bn Series B", date(2000, 1, 3))]
    df = spark.createDataFrame(rows, "company_id long, id long, title string, published_date date")
    assert {r.id: r.story for r in timeline.stories(df).collect()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5}


def test_fuzzy_pairs_lose_nothing(spark):
    rng = np.random.default_rng(4)
    words = ["alpha", "alpina", "beta", "betas", "gamma", "delta", "delt"]
    df = spark.createDataFrame([(int(n), " ".join(rng.choice(words, 2))) for n in range(60)], "id long, name string")
    got = {(r.left_id, r.right_id) for r in similarity.fuzzy_pairs(df, df, 0.5, distinct_order=True).collect()}
    a, b = df.toDF("i", "x"), df.toDF("j", "y")
    want = {(r.i, r.j) for r in a.join(b, F.col("i") < F.col("j")).where(similarity.trigram_similarity(F.col("x"), F.col("y")) >= 0.5).collect()}
    assert got == want
    assert one(spark, similarity.trigram_similarity(F.lit("word"), F.lit("words"))) == pytest.approx(4 / 7)


def test_copies_of_names_meet_as_classes(spark):
    words = ["red bolt", "Bolt, red", "red bolts", "blue bolt", "gear"]
    df = spark.createDataFrame([(n, words[n * n % 5]) for n in range(200)], "id long, name string")
    pairs, rows, _ = similarity.alike_classes(df, df, 0.5)
    assert pairs.count() <= 16 and rows.count() == 200
    a, b = df.toDF("i", "x"), df.toDF("j", "y")
    s = similarity.trigram_similarity(F.col("x"), F.col("y"))
    every = [(r.i, r.j, r.s) for r in a.join(b, F.col("i") != F.col("j")).select("i", "j", s.alias("s")).where("s >= 0.5").collect()]
    assert {tuple(r) for r in similarity.fuzzy_pairs(df, df, 0.5).collect()} == set(every)
    best = {i: sorted((-s, j) for k, j, s in every if k == i)[:2] for i in {i for i, _, _ in every}}
    assert {r.left_id: [(-f.similarity, f.right_id) for f in r.found] for r in similarity.closest(df, df, 0.5, 2).collect()} == best
    clear = {(i, b[0][1]) for i, b in best.items() if len(b) == 1 or b[1][0] - b[0][0] >= 0.08}
    assert {(r.left_id, r.right_id) for r in similarity.best_alike(df, df, 0.5, 0.08).collect()} == clear
    least = {j: min(i for i, k, _ in every if k == j and i < j and (i + j) % 2 == 0) for j in {j for i, j, _ in every if i < j and (i + j) % 2 == 0}}
    assert {r.right_id: r.left_id for r in similarity.smallest_alike(df, 0.5, F.pmod("id", F.lit(2))).collect()} == least


def broadcast_tables(df) -> list[str]:
    """Broadcasts of a plan whose rows come from a table without a shuffle, so that nothing tells their size."""
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    depth = [len(x) - len(x.lstrip(" :+-")) for x in lines]
    out = []
    for n, line in enumerate(lines):
        if "BroadcastExchange" in line:
            below = list(itertools.takewhile(lambda k: depth[k] > depth[n], range(n + 1, len(lines))))
            if not any("Exchange hashpartitioning" in lines[k] for k in below):
                out.append("\n".join(lines[k] for k in [n, *below]))
    return out


@pytest.mark.parametrize("query", ["J19_fuzzy_pairs", "J20_best_match", "J21_find_one", "M13_gated_pairs"])
def test_rows_of_names_pass_no_driver(spark, sf_dir, query):
    assert broadcast_tables(queries()[query](spark, sf_dir)) == []


def test_lists_of_pieces_give_every_pair(spark, monkeypatch):
    monkeypatch.setattr(similarity, "PIECE", 4)
    monkeypatch.setattr(similarity, "PIECES", 3)
    words = ["red bolt", "Bolt, red", "red bolts", "blue bolt", None, " - "]
    df = spark.createDataFrame([(n, words[n * n % 6]) for n in range(150)], "id long, name string")
    a, b = df.toDF("i", "x"), df.toDF("j", "y")
    want = {(r.i, r.j) for r in a.join(b, F.col("i") < F.col("j")).where(similarity.trigram_similarity(F.col("x"), F.col("y")) >= 0.5).collect()}
    pairs = similarity.fuzzy_pairs(df, df, 0.5, distinct_order=True)
    got = [(r.left_id, r.right_id) for r in pairs.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    # the last join has lists, not rows
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode(left") < plan.index("Join Inner")


def test_graph_and_shards(spark):
    links = spark.createDataFrame([(1, 10), (1, 11), (2, 10), (2, 11), (2, 12), (3, 12)], "investor_id long, company_id long")
    assert [tuple(r) for r in graph.also_backed_by(links, 10, 2).collect()] == [(11, 1)]
    df = spark.createDataFrame([(f"s{n:03d}",) for n in range(95)], "slug string")
    got = {r.slug: r.shard for r in windows.shard(df, "slug", 10).collect()}
    assert got == {f"s{n:03d}": n // 10 for n in range(95)}


def test_clusters(spark):
    assert [clusters.choose_k(n) for n in (1, 8, 50, 5000)] == [2, 2, 5, 10]
    x = np.array([[0, 0], [0, 0.1], [5, 5], [5, 5.1]])
    assert clusters.kmeans(x, 2).tolist() == [0, 0, 1, 1]
    assert clusters.match_centroids([("a", "x", 0.95), ("b", "x", 0.97), ("a", "y", 0.91)]) == [("b", "x", 0.97), ("a", "y", 0.91)]
    df = spark.createDataFrame([("g", n, [float(n), 0.0, 1.0]) for n in range(4)], "g string, id long, v array<double>")
    got = {r.id: (round(r.x, 6), r.y) for r in clusters.project(df, "g", "id", "v").collect()}
    assert got[0][0] in (0.0, 1.0) and sorted(v[0] for v in got.values()) == [0.0, 0.333333, 0.666667, 1.0]


def test_filters(spark):
    assert predicates.sanitize_term(" a,(b)%  c\\ ") == "a b c"
    df = spark.createDataFrame([(1, "n", "d", ["x"], 10, 20)], "id int, name string, description_short string, tags array<string>, employee_count_min int, employee_count_max int")
    assert predicates.filter_companies(df, q="N", tag="x", emp_min=15, emp_max=15).count() == 1
    assert predicates.filter_companies(df, tag="y").count() == 0
    assert predicates.filter_companies(df).count() == 1


def test_feeds_and_sinks(spark, tmp_path):
    (tmp_path / "f.xml").write_text("<rss><channel><item><title>Acme raises cash</title><link>http://a/1</link><pubDate>Tue, 31 Jul 2001 10:00:00 GMT</pubDate><description>big</description></item><item><title>Weather</title><link>http://a/2</link><pubDate>Tue, 31 Jul 2001 10:00:00 GMT</pubDate><description>rain</description></item></channel></rss>")
    assert [(r.link, r.published) for r in feeds.read_rss(spark, str(tmp_path / "f.xml"), "2001-08-01", feeds.OUTLETS["siliconangle"]).collect()] == [("http://a/1", date(2001, 7, 31))]
    (tmp_path / "s.xml").write_text('<urlset xmlns="http://s"><url><loc>http://a/x</loc></url></urlset>')
    assert [r.url for r in feeds.read_sitemap(spark, str(tmp_path / "s.xml")).collect()] == ["http://a/x"]
    (tmp_path / "l.json").write_text('[{"n": "A", "w": "u"}, {"n": " ", "w": null}, {"n": "A", "w": "u"}]')
    assert [tuple(r) for r in feeds.read_listing(spark, str(tmp_path / "l.json"), "n string, w string", "n", "w").collect()] == [("A", "u")]
    with pytest.raises(Exception, match="has no row"):
        feeds.nonempty(spark.range(0), "empty source").collect()
    html = spark.createDataFrame([('<div class="card x"><a href="/a">Acme</a><br></div><div class="card">B <b>C</b></div>',)], "h string")
    assert {tuple(r) for r in feeds.read_cards(html, "h", "card").collect()} == {("Acme", "/a"), ("B C", None)}
    page = spark.createDataFrame([('x; window.data = {"k": [1, 2]};',)], "h string")
    assert feeds.islands(page, "h", "window.data", "k array<int>").first().island.k == [1, 2]
    doubled = feeds.external(spark.range(3), lambda rows: [{"id": 2 * r["id"]} for r in rows], "id long")
    assert sorted(r.id for r in doubled.collect()) == [0, 2, 4]
    df = spark.createDataFrame([("b", 'say "x"'), ("a", None)], "slug string, name string")
    sinks.write_csv(df, str(tmp_path / "csv"))
    back = spark.read.csv(str(tmp_path / "csv"), header=True, escape='"')
    assert {tuple(r) for r in back.collect()} == {("b", 'say "x"'), ("a", None)}
    sinks.write_sitemap(df, str(tmp_path / "map"), "http://s/", 1)
    assert spark.read.text(str(tmp_path / "map")).count() == 2
    assert sinks.markdown_table(df.orderBy("slug")).splitlines()[2] == "| a |  |"


def test_streams(spark, tmp_path):
    src = "/root/testdata/sf0.001/events.parquet"
    batch = spark.read.parquet(src)
    batch.write.parquet(str(tmp_path / "in"))
    stream = ingest.read_events(spark, str(tmp_path / "in"), batch.schema)
    weekly = ingest.run_to_table(ingest.weekly_counts(stream, "event_type", "1 day"), "weekly", str(tmp_path / "c1"), "complete")
    assert weekly.agg(F.sum("n")).first()[0] == batch.count()
    firsts = ingest.run_to_table(ingest.first_of(stream, ["user_id"], "60 days"), "firsts", str(tmp_path / "c2"))
    assert firsts.count() == batch.select("user_id").distinct().count()
    for n in (1, 2):
        ingest.unprocessed_only(stream, str(tmp_path / "ledger"), str(tmp_path / "out"), str(tmp_path / f"c3{n}"), "event_id").awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == batch.count()
