"""Tables laid out by key, landed lines that are no page, and batches of a stream."""

from __future__ import annotations

import json
import random
from datetime import datetime, timedelta, timezone
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from broadsheet.operators import assets, feed, issue
from broadsheet.plans.issue import issue_to, landed_pages, run_issue, write_issue
from broadsheet.registry.queries import QUERIES
from broadsheet.session import checkpoint_dir, materialize, work_tables
from broadsheet.sources import cache, feed as source, pages as P
from broadsheet.streaming import ingest

SCHEMA = "slug string, html string, fetched_at int"
NOW = datetime(2026, 3, 20, 9, tzinfo=timezone.utc)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def last_write_plan(spark):
    store = spark._jsparkSession.sharedState().statusStore()
    runs = store.executionsList()
    plans = [runs.apply(i).physicalPlanDescription() for i in range(runs.size())]
    return [plan for plan in plans if "InsertIntoHadoopFsRelation" in plan][-1]


def files(path):
    return {p.parent.name: {f.name for f in p.parent.glob("*.parquet")} for p in Path(path).glob("bucket=*/*.parquet")}


def test_upsert_rewrites_touched_folders_only(spark, tmp_path):
    path = f"{tmp_path}/cache"
    old = [(f"s{i}", f"old {i}", i) for i in range(200)]
    cache.upsert_buckets(spark, path, spark.createDataFrame(old, SCHEMA), n_buckets=32)
    assert "Sort" not in last_write_plan(spark)
    before = files(path)
    new = [("s7", "new", 900), ("s7", "newer", 901), ("x", "added", 1), (None, "no key", 5), (None, "no key, later", 6)]
    merged = cache.upsert_buckets(spark, path, spark.createDataFrame(new, SCHEMA), n_buckets=32)
    got = {r["slug"]: r["html"] for r in spark.read.parquet(path).collect()}
    want = {slug: html for slug, html, _ in old} | {"s7": "newer", "x": "added", None: "no key, later"}
    assert got == want and spark.read.parquet(path).count() == len(want)
    touched = {f"bucket={r['bucket']}" for r in merged.select("bucket").distinct().collect()}
    after = files(path)
    assert 0 < len(touched) <= 3
    assert {b for b in after if after[b] != before.get(b)} == touched


def test_upsert_with_nothing_new(spark, tmp_path):
    path = f"{tmp_path}/cache"
    none = spark.createDataFrame([], SCHEMA)
    assert cache.upsert_buckets(spark, path, none).count() == 0
    cache.upsert_buckets(spark, path, spark.createDataFrame([("a", "1", 1)], SCHEMA))
    before = files(path)
    cache.upsert_buckets(spark, path, none)
    assert files(path) == before


@pytest.mark.parametrize("most", [cache.MAX_BROADCAST_KEYS, 1])
def test_texts_are_not_sorted(spark, tmp_path, monkeypatch, most):
    monkeypatch.setattr(cache, "MAX_BROADCAST_KEYS", most)
    spark.createDataFrame([(f"s{i}", "t", i) for i in range(50)], SCHEMA).write.parquet(f"{tmp_path}/old")
    new = spark.createDataFrame([(f"s{i % 9}", f"n{i}", i) for i in range(30)], SCHEMA)
    df = cache.cache_upsert(spark.read.parquet(f"{tmp_path}/old"), new)
    plan = plan_of(df)
    assert "Sort" not in plan and "Aggregate" not in plan
    got = {r["slug"]: r["html"] for r in df.collect()}
    assert got == {f"s{i}": "t" for i in range(50)} | {f"s{i}": f"n{max(range(i, 30, 9))}" for i in range(9)}


def test_laid_out_pages_stay_where_they_lie(spark, tmp_path):
    rows = [(i, f"u{i % 40}", f"<p>{i}</p>") for i in range(200)]
    P.lay_out_pages(spark.createDataFrame(rows, "page_id long, url string, html string"), "laid_out", 4, f"{tmp_path}/pages")
    refs = spark.range(1_000_000).select(F.concat(F.lit("u"), F.col("id") % 60).alias("url"), F.col("id").alias("no"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = P.join_laid_out(refs, "laid_out")
        plan = plan_of(df)
        for line, after in zip(plan.splitlines(), plan.splitlines()[1:]):
            assert not ("Exchange" in line or "Sort " in line) or "html" not in after
        exchanges = [line for line in plan.splitlines() if "Exchange" in line]
        assert len(exchanges) == 1 and "SelectedBucketsCount: 4 out of 4" in plan
        got = df.groupBy("url", "page_id", "html").count().collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE laid_out")
    assert {(r["url"], r["page_id"], r["html"]) for r in got} == {(f"u{i}", i, f"<p>{i}</p>") for i in range(40)}
    assert sum(r["count"] for r in got) == sum(1 for i in range(1_000_000) if i % 60 < 40)


def test_malformed_lines_are_rejects(spark, tmp_path):
    page = '{"page": %d, "totalItems": 9, "member": [{"title": "t%d", "link": "https://n.example/%d"}]}'
    lines = [page % (i, i, i) for i in range(1, 60)]
    bad = {4: '{"page": 5, "member": [{"title": "cut', 17: "no json", 30: '{"page": "x1", "member": "none"}', 44: ""}
    for at, text in bad.items():
        lines[at] = text
    (tmp_path / "feed").mkdir()
    (tmp_path / "feed" / "a.json").write_text("\n".join(lines) + "\n")
    (tmp_path / "feed" / "posts_7.json").write_text('{"member": []}\n{"totalItems": 3, "member": [{"title": "z"}')
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700b")
    try:
        pages, rejects = source.read_feed_checked(spark, f"{tmp_path}/feed")
        found = {(r["file"].rpartition("/")[2], r["line"], r["record"]) for r in rejects.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    assert found == {("a.json", at + 1, text) for at, text in bad.items() if text} | {("posts_7.json", 2, '{"totalItems": 3, "member": [{"title": "z"}')}
    assert sorted(r["page"] for r in pages.collect()) == sorted([i + 1 for i in range(59) if i not in bad] + [7])
    assert source.feed_members(pages).count() == 55


def land(folder, rng, n_pages=24):
    """Pages in files of random order; members repeat addresses, some are old, undated or cut."""
    places = []
    texts = []
    for page in range(1, n_pages + 1):
        members = []
        for pos in range(6):
            when = NOW - timedelta(days=rng.choice([0, 1, 2, 6, 9]), minutes=rng.randrange(60))
            url = f"https://news.example/news/{rng.randrange(30)}"
            member = {"title": f"t{page}-{pos}", "link": url, "published": when.isoformat()}
            if rng.random() < 0.1:
                del member["published"]
            members.append(member)
            places.append((page, pos, member))
        texts.append(json.dumps({"page": page, "totalItems": 999, "member": members}))
    texts.append(texts[0][:70])
    rng.shuffle(texts)
    folder.mkdir()
    for no in range(8):
        (folder / f"p{no}.json").write_text("\n".join(texts[no::8]))
    return places


def test_batches_equal_first_wins(spark, tmp_path):
    places = land(tmp_path / "landed", random.Random(6))
    out = f"{tmp_path}/tables"
    lines = ingest.read_line_stream(spark, f"{tmp_path}/landed", files_per_batch=2)
    ingest.ingest_feed(lines, out, f"{tmp_path}/state", 7, NOW, n_buckets=8).awaitTermination()
    since = feed.cutoff(NOW, 7)
    want, n_late, n_bad = {}, 0, 0
    for page, pos, m in places:
        if "published" not in m:
            n_bad += 1
        elif datetime.fromisoformat(m["published"]) < since:
            n_late += 1
        else:
            want.setdefault(m["link"], (page, pos, m["title"]))

    def stored():
        rows = spark.read.parquet(f"{out}/refs").collect()
        return {r["url"]: (r["page_no"], r["pos"], r["title"]) for r in rows}, len(rows)

    assert stored() == (want, len(want))
    batches = spark.read.parquet(f"{out}/batches").collect()
    assert len(batches) == 4
    for b in batches:
        assert b["rejected"] + b["late"] + b["kept"] + b["duplicate"] == b["landed"]
    assert [sum(b[c] for b in batches) for c in ("landed", "rejected", "late")] == [len(places), n_bad, n_late]
    assert spark.read.parquet(f"{out}/malformed").count() == 1
    outcomes = {r["outcome"]: r["count"] for r in spark.read.parquet(f"{out}/outcomes").groupBy("outcome").count().collect()}
    assert outcomes["late"] == n_late and outcomes["rejected"] == n_bad

    again = source.feed_lines(spark.read.text(f"{tmp_path}/landed")).where("file in ('p0.json', 'p1.json')")
    ingest.merge_batch(again, 0, out, 7, NOW, n_buckets=8)
    assert stored() == (want, len(want))
    assert len(spark.read.parquet(f"{out}/batches").collect()) == 4


def test_pages_behind_the_stop_are_not_read(spark, tmp_path):
    path = f"{tmp_path}/feed"
    rows = [(page, pos, NOW - timedelta(hours=page + pos / 60)) for page in range(1, 400) for pos in range(3)]
    df = spark.createDataFrame(rows, "page_no int, pos int, published timestamp")
    df.repartition("page_no").write.partitionBy("page_no").parquet(path)
    for page in range(200, 400):
        for file in Path(path, f"page_no={page}").glob("*.parquet"):
            file.write_bytes(b"not read")
            (file.parent / f".{file.name}.crc").unlink(missing_ok=True)
    stored = spark.read.schema("pos int, published timestamp, page_no int").parquet(path)
    since = NOW - timedelta(hours=30, minutes=1)
    kept = feed.take_while_in_ranges(stored, ["page_no", "pos"], since, first=4)
    want = [(page, pos) for page, pos, at in rows if at >= since]
    assert sorted((r["page_no"], r["pos"]) for r in kept.collect()) == want
    every = spark.createDataFrame(rows[:50], "page_no int, pos int, published timestamp")
    assert feed.take_while_in_ranges(every, ["page_no", "pos"], NOW - timedelta(days=99), first=2).count() == 50
    with pytest.raises(ValueError, match="page"):
        feed.take_while_in_ranges(every, ["pos"], since)


def test_asset_files(spark, tmp_path):
    sizes = {"a": 10, "b": 3000, "c": 0}
    for key, size in sizes.items():
        folder = tmp_path / "images" / (f"asset_key={key}" if key != "b" else "x")
        folder.mkdir(parents=True)
        (folder / ("part-0" if key != "b" else "b.jpg")).write_bytes(b"x" * size)
    files = assets.asset_files(spark, f"{tmp_path}/images")
    assert {r["asset_key"]: r["n_bytes"] for r in files.collect()} == {"a": 10, "b": 3000}
    assert "content" not in plan_of(files)
    manifest = spark.createDataFrame([(k,) for k in "abcd"], "asset_key string")
    judged = {r["asset_key"]: r["asset_status"] for r in assets.judge_assets(manifest, files, max_bytes=2000).collect()}
    assert judged == {"a": "ok", "b": "too_large", "c": "missing", "d": "missing"}
    contents = assets.asset_contents(spark, f"{tmp_path}/images", max_bytes=2000)
    assert "LessThanOrEqual(length,2000)" in plan_of(contents)
    assert [(r["asset_key"], bytes(r["content"])) for r in contents.collect()] == [("a", b"x" * 10)]


def test_landed_assets(spark, tmp_path):
    sizes = {"a": 10, "b": 3000, "c": 0}
    rows = [(key, bytearray(b"x" * size)) for key, size in sizes.items()]
    assets.land_assets(spark.createDataFrame(rows, "asset_key string, content binary"), f"{tmp_path}/images")
    landed = assets.landed_assets(spark, f"{tmp_path}/images")
    assert {r["asset_key"]: (r["n_bytes"], r["error"]) for r in landed.collect()} == {"a": (10, None), "b": (3000, None)}
    assert "content" not in plan_of(landed)


def test_images_of_the_query_land_in_few_files(spark, tmp_path):
    pages = spark.range(60).select(
        F.col("id").alias("page_id"),
        F.concat(F.lit("https://news.example/"), "id").alias("url"),
        F.lit("<article><h1>a</h1><p>b</p></article>").alias("html"),
    )
    pages.coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    before = set(Path(checkpoint_dir(spark)).glob("run-*/images"))
    rows = QUERIES["asset_files_judged"](spark, str(tmp_path)).collect()
    assert {(int(r["url"][21:]), r["idx"]): r["asset_status"] for r in rows} == {
        (i, idx): "missing" if i % 7 == 3 else "ok" if i % 50 < 25 else "too_large" for i in range(60) for idx in (0, 1)
    }
    (landed,) = set(Path(checkpoint_dir(spark)).glob("run-*/images")) - before
    # 104 images, at most a file for each shuffle partition
    assert len([f for f in landed.rglob("*") if f.is_file() and f.name[0] not in "._"]) <= 4


def test_documents_are_written_in_few_files(spark, tmp_path):
    docs = spark.range(4000).select(
        F.col("id").cast("string").alias("path"),
        F.when(F.col("id") % 10 < 7, "Kraj").otherwise(F.concat(F.lit("c"), F.col("id") % 10)).alias("category"),
        F.repeat(F.sha2(F.col("id").cast("string"), 256), 20).alias("content"),
    )
    write_issue({"documents": docs.repartition(16)}, f"{tmp_path}/issue")
    found = list(Path(f"{tmp_path}/issue/documents").glob("category=*/*.parquet"))
    assert len({f.parent for f in found}) == 4 and len(found) <= 4 + 1
    assert spark.read.parquet(f"{tmp_path}/issue/documents").count() == 4000


def test_authors_in_the_order_of_a_language(spark):
    names = ["Zofia", "Żaneta", "Ćwik", "Dorn", "Łoś", "Lis", "adam"]
    df = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "author string, chapter_no long")

    def order(**kw):
        return [r["author"] for r in issue.author_groups(df, **kw).orderBy("author_pos").collect()]

    assert order() == ["adam", "Dorn", "Lis", "Zofia", "Ćwik", "Łoś", "Żaneta"]
    assert order(collation="pl") == ["adam", "Ćwik", "Dorn", "Lis", "Łoś", "Zofia", "Żaneta"]


def test_pages_of_a_run_come_from_cache_or_fetches(spark):
    window = spark.createDataFrame([(f"https://n.example/{s}",) for s in ("a", "b", "c", "d", "b")], "url string")
    stored = spark.createDataFrame([("a", "cached a"), ("z", "other")], "slug string, html string")
    rows = [("a", 500, None, "x"), ("b", 200, None, "page b"), ("b", None, "timeout", None), ("c", 404, None, None), ("q", 500, None, "")]
    fetches = spark.createDataFrame([(f"https://n.example/{s}", *r) for s, *r in rows], "url string, status int, error string, html string")
    pages, skipped = landed_pages(window, fetches, stored, strict=True)
    assert {(r["url"][-1], r["html"]) for r in pages.collect()} == {("a", "cached a"), ("b", "page b")}
    assert {(r["url"][-1], r["reject_reason"]) for r in skipped.collect()} == {("c", "http_404"), ("d", "not_fetched")}
    pages, skipped = landed_pages(window, fetches)
    assert {r["url"][-1] for r in pages.collect()} == {"b"}
    assert {(r["url"][-1], r["reject_reason"]) for r in skipped.collect()} == {("a", "http_500"), ("c", "http_404"), ("d", "not_fetched")}


def test_work_tables_are_removed(spark):
    def tables():
        return {p.name for p in Path(checkpoint_dir(spark)).glob("table-*")}

    before = tables()
    with work_tables(spark) as keep:
        with work_tables(spark) as keep_inner:
            one, two = materialize(spark.range(3)), materialize(spark.range(4))
            both = keep_inner(materialize(one.union(two)))
            assert len(tables() - before) == 3
        assert len(tables() - before) == 1
        keep(both)
    assert both.count() == 7 and len(tables() - before) == 1
    with pytest.raises(ZeroDivisionError):
        with work_tables(spark):
            materialize(spark.range(2))
            1 / 0
    assert len(tables() - before) == 1


def test_a_run_leaves_no_work_tables(spark, tmp_path):
    before = set(Path(checkpoint_dir(spark)).glob("table-*"))
    url = "https://news.example/news/tide"
    row = ("Tide", url, NOW - timedelta(days=1), "Kraj", "Jo", 1, 0)
    refs = spark.createDataFrame([row], "title string, url string, published timestamp, category string, author_hint string, page_no int, pos int")
    html = '<h1>Tide</h1><div class="prose"><p class="post-excerpt">Lead</p><section><div class="ad-slot">ad</section><p>body</p></div>'
    fetches = spark.createDataFrame([(url, 200, None, html)], "url string, status int, error string, html string")
    issue_to(f"{tmp_path}/issue", spark, refs, fetches, NOW)
    assert set(Path(checkpoint_dir(spark)).glob("table-*")) == before
    document = spark.read.parquet(f"{tmp_path}/issue/documents").first()
    assert document["path"] == "chapters/tide.xhtml" and "<section></section><p>body</p>" in document["content"]
    for old, got in ((refs, fetches.where("false")), (refs.where("false"), fetches)):
        with pytest.raises(feed.EmptyWindow), work_tables(spark):
            run_issue(old, got, NOW)
    rejects = spark.read.parquet(f"{tmp_path}/issue/rejects").collect()
    assert [(r["url"], r["reject_reason"]) for r in rejects] == [(url, "unclosed_markup")]
