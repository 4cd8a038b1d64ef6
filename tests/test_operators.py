"""Graph, sweep, logs, change feeds, plans and streams on small inputs."""

import json
import os
import subprocess
import time

import pytest
from pyspark.sql import functions as F

from folioscope.engine import Engine
from folioscope.operators import changes, graph, logs, rawsweep
from folioscope.operators.stored import StoredIndex
from folioscope.plans import ingest
from folioscope.sources import files, git
from folioscope.streaming import jobs


def chain(spark, edges, seeds):
    e = spark.createDataFrame(edges, "src string, nxt string")
    s = spark.createDataFrame([(x,) for x in seeds], "seed string")
    return {r.seed: (r.active, r.hops) for r in graph.chains(s, e).collect()}


def test_chains(spark):
    got = chain(spark, [("a", "b"), ("b", "c"), ("x", "x"), ("p", "q"), ("q", "p"), ("r", "p")], "abcxpqrz")
    assert got == {"a": ("c", 2), "b": ("c", 1), "c": ("c", 0), "x": ("x", 0), "p": ("q", 1), "q": ("p", 1), "r": ("q", 2), "z": ("z", 0)}


def test_a_long_chain(spark):
    got = chain(spark, [(f"{i:03}", f"{i + 1:03}") for i in range(150)], ["000", "149"])
    assert got == {"000": ("150", 150), "149": ("150", 1)}


def test_smallest_source_wins(spark):
    e = spark.createDataFrame([("b", "supersedes", 0, "x"), ("a", "supersedes", 0, "x"), ("x", "supersedes", 0, "x")], "src string, key string, ord int, dst string")
    assert graph.inverted(e).collect()[0].asDict() == {"dst": "x", "all_sources": ["a", "b"], "first_source": "a"}


def test_sweep_order(spark):
    raw = spark.createDataFrame([("raw/a/1", "2024-01-02", False), ("raw/a/2", "2024-01-02", True), ("raw/a/3", "2024-01-02", False), ("raw/a/4", "", False), ("raw/a/t.tmp", "", True), ("raw/a/INGESTION.md", "", False)], "raw_rel string, last_commit_date string, dirty boolean")
    rules = spark.createDataFrame([("raw/a", "*.tmp"), ("raw/b", "*")], "folder string, pattern string")
    pointers = spark.createDataFrame([("raw/a/2", "p"), ("raw/a/3", "p"), ("raw/a/4", "p")], "raw_rel string, page_ref string")
    pages = spark.createDataFrame([("p", "2024-01-01")], "page_ref string, git_date string")
    got = {r.raw_rel: r.reason for r in rawsweep.sweep(rawsweep.scoped(raw, "raw/a"), rules, pointers, pages).collect()}
    assert got == {"raw/a/1": "never_ingested", "raw/a/2": "dirty", "raw/a/3": "changed"}


def test_dirty_ignores_line_ends_of_text(spark):
    a = spark.createDataFrame([("t", b"a\r\nb"), ("b", b"\x00\r\n"), ("gone", b"x")], "path string, content binary")
    b = spark.createDataFrame([("t", b"a\nb"), ("b", b"\x00\n"), ("new", b"x")], "path string, content binary")
    assert sorted(r.path for r in changes.dirty(a, b).collect()) == ["b", "gone", "new"]


def test_transcripts(spark):
    lines = [
        {"type": "user", "message": {"role": "user", "content": " hi "}},
        {"type": "assistant", "message": {"role": "assistant", "content": [{"type": "text", "text": " a "}, {"type": "tool", "text": "x"}, {"type": "text", "text": "b"}]}},
        {"type": "user", "isMeta": True, "message": {"role": "user", "content": "no"}},
        {"type": "system", "message": {"role": "system", "content": "no"}},
    ]
    df = spark.createDataFrame([(i, json.dumps(x)) for i, x in enumerate(lines)] + [(9, "garbled {")], "seq int, value string")
    assert [(r.role, r.text) for r in logs.transcript_turns(df).orderBy("seq").collect()] == [("user", "hi"), ("assistant", "a\n\nb")]
    doc = {"messages": [{"info": {"role": "user"}, "parts": [{"type": "text", "text": " q "}]}, {"info": {"role": "tool"}, "parts": []}]}
    df = spark.createDataFrame([("d", json.dumps(doc))], "doc string, value string")
    assert [(r.role, r.text) for r in logs.export_turns(df).collect()] == [("user", "q")]


def test_files(spark, tmp_path):
    (tmp_path / "wiki/concepts/deep").mkdir(parents=True)
    (tmp_path / "raw/a b").mkdir(parents=True)
    for p, t in (("wiki/concepts/a.md", "---\ntitle: A\ntags: [x, y]\nsource: ['[s](../sources/s.md)']\n---\nbody"), ("wiki/concepts/bad.md", "---\na: [\n---\n"), ("wiki/_index.md", "i"), ("wiki/concepts/deep/b.md", "b"), ("raw/a b/f.txt", "f"), ("raw/a b/INGESTION.md", "i"), ("raw/a b/.ingestignore", "*.tmp # t\n\n")):
        (tmp_path / p).write_text(t)
    pages = files.disk_pages(spark, str(tmp_path))
    assert sorted(r.page_ref for r in pages.collect()) == ["wiki/concepts/a.md", "wiki/concepts/bad.md"]
    parsed = files.records(pages)
    assert [(r.page_ref, r.title, r.tags, r.kind, r.body) for r in parsed.collect()] == [("wiki/concepts/a.md", "A", ["x", "y"], "concept", "body")]
    assert [(r.key, r.dst) for r in files.record_edges(parsed).collect()] == [("source", "wiki/sources/s.md")]
    with pytest.raises(Exception, match="invalid frontmatter"):
        files.records(pages, "FAILFAST").collect()
    assert [r.raw_rel for r in files.raw_files(spark, str(tmp_path)).collect()] == ["raw/a b/f.txt"]
    (tmp_path / "log.jsonl").write_text('{"tool":"a","prompt_id":"p"}\n\nbad\n{"tool":null,"duration_ms":1.5}\n')
    log = files.json_log(spark, str(tmp_path / "log.jsonl"))
    assert sorted((r.tool or "?", r.calls) for r in logs.tool_histogram(log).collect()) == [("?", 1), ("a", 1)]


def plan(spark, raw="", **fields):
    page = {"op": "create", "title": "New page", "kind": "concept", "body": "text\n"} | fields
    return ingest.decode(spark.createDataFrame([(1, json.dumps({"title": "t", "raw": raw, "pages": [page]}))], "plan_id int, value string"))


EXISTING = [("wiki/sources/s.md", "Stub", "---\ntitle: Stub\nrelated:\n  - a\n---\nold\n")]


RAW = {"raw": "raw/a b (1).txt"}
STUB = {"title": "Stub page", "kind": "source", "frontmatter": {"raw_source": True}}


@pytest.mark.parametrize(
    "fields,error",
    [
        ({}, None),
        ({"op": "x"}, "neither create nor update"),
        ({"title": ""}, "without a title"),
        ({"kind": "no"}, "unknown kind"),
        ({"body": None}, "without a body"),
        ({"page_ref": "p"}, "names its own path"),
        ({"op": "update"}, "gives a kind"),
        ({"frontmatter": {"source_date": "x"}}, "is no date"),
        ({"frontmatter": {"source_date": 7}}, "is no date"),
        ({"frontmatter": {"raw_source": "no"}}, "not true"),
        ({"frontmatter": {"raw_source": True}}, "without a raw file"),
        ({"edges": [{"key": "related", "targets": ["wiki/a/none.md"]}]}, "edge to no page: wiki/a/none.md"),
        ({"edges": {"related": ["wiki/a/none.md"]}}, "edge to no page: wiki/a/none.md"),
        ({"op": "update", "kind": "", "page_ref": "wiki/a/none.md"}, "there is no page"),
        ({"title": "x" * 300, "kind": "own"}, None),
        (RAW, "source of its raw file"),
        (RAW | STUB, None),
    ],
)
def test_plan_errors(spark, fields, error):
    existing = spark.createDataFrame(EXISTING, "page_ref string, title string, text string")
    got = ingest.errors(plan(spark, **fields), existing, "/r", {"own": "owns"}).collect()
    assert (not got) if error is None else error in got[0].errors


def test_plans_are_executed(spark, tmp_path):
    existing = spark.createDataFrame(EXISTING, "page_ref string, title string, text string")
    p = plan(spark, "raw/a.txt", frontmatter={"source_date": "2024-02-03T10:00", "raw_source": True}, edges=[{"key": "source", "targets": ["wiki/sources/s.md"]}, {"key": "supersedes", "targets": ["wiki/sources/s.md"]}])
    out = ingest.resolved(p, existing)
    row = out.collect()[0]
    assert row.target == "wiki/concepts/new-page.md"
    assert 'source_date: 2024-02-03\n' in row.text and '  - "[Stub](../sources/s.md)"\n' in row.text and row.text.endswith("---\ntext\n")
    m = ingest.manifest(out, p).collect()[0].manifest
    assert m.created == ["wiki/concepts/new-page.md"] and m.superseded[0].old == "wiki/sources/s.md"
    ingest.write_pages(out.withColumnRenamed("target", "page_ref"), str(tmp_path))
    assert (tmp_path / row.target).read_text() == row.text
    from folioscope.functions.columns import commit_message, manifest_paths

    made = ingest.manifest(out, p)
    assert made.select(commit_message()).first()[0] == "ingest: t\n\ncreated: wiki/concepts/new-page.md\nsuperseded: wiki/sources/s.md -> wiki/concepts/new-page.md"
    assert made.select(manifest_paths()).first()[0] == ["wiki/concepts/new-page.md", "wiki/sources/s.md", "raw/a.txt"]


def test_lists_of_plans_are_merged_and_links_encoded(spark):
    """Fields keep their types and order; raw files with spaces are links that are read back."""
    existing = spark.createDataFrame([("wiki/sources/s.md", "Stub", "---\ntitle: Stub\ntags: [x, y]\n---\nold\n")], "page_ref string, title string, text string")
    fields = {"tags": ["y", "z"], "n": 3, "raw_source": True, "flag": False}
    made = ingest.resolved(plan(spark, "raw/a b (1).txt", title="New", frontmatter=fields, body="see [q](../sources/a b.md)\n" + "x"), existing).first().text
    assert made.startswith('---\ntitle: New\ntags:\n  - y\n  - z\nn: 3\nraw_source: "[a b (1).txt](../../raw/a%20b%20%281%29.txt)"\nflag: false\n---\n')
    got = ingest.resolved(plan(spark, op="update", title="Stub", kind="", page_ref="wiki/sources/s.md", body=None, frontmatter={"tags": ["y", "z"]}, edges={"related": ["wiki/sources/s.md"]}), existing).first().text
    assert got == '---\ntitle: Stub\ntags:\n  - x\n  - y\n  - z\nrelated:\n  - "[Stub](s.md)"\n---\nold\n'
    raw = files.record_edges(files.records(spark.createDataFrame([("wiki/concepts/n.md", made)], "page_ref string, text string"))).where("key = 'raw_source'").first()
    assert raw.dst == "raw/a b (1).txt"


def test_queue_rows_are_removed(spark, tmp_path):
    q, rows = str(tmp_path / "q"), lambda *r: spark.createDataFrame([(x,) for x in r], "rel string")
    there = lambda: sorted(r.rel for r in jobs.pending(spark, q).collect())
    jobs._enter(rows("a", "b", "a", ""), False, q)
    assert there() == ["a", "b"]
    jobs.remove(spark, q, rows("a", "c"))
    assert there() == ["b"]
    # An entry that didn't get to its end leaves the queue as it was.
    (tmp_path / "q/x/_temporary/0").mkdir(parents=True)
    (tmp_path / "q/x/_temporary/0/part-0.parquet").write_bytes(b"broken")
    assert there() == ["b"]
    jobs._enter(rows("a"), False, q)
    assert there() == ["a", "b"]


def test_edits_and_removals_are_events(spark, tmp_path):
    """W-01: the first listing gives none; a run that is repeated gives the same."""
    raw, state = tmp_path / "v/raw/n", str(tmp_path / "state")
    raw.mkdir(parents=True)
    listed = lambda: files.raw_files(spark, str(tmp_path / "v"))
    found = lambda k: sorted((r.rel, r.change) for r in jobs.file_changes(spark, listed, state, k).collect())
    (raw / "a.txt").write_text("a")
    (raw / "b.txt").write_text("b")
    assert found(0) == []
    (raw / "a.txt").write_text("longer")
    (raw / "b.txt").unlink()
    (raw / "c d.txt").write_text("c")
    want = [("raw/n/a.txt", "changed"), ("raw/n/b.txt", "gone"), ("raw/n/c d.txt", "created")]
    assert found(1) == want
    (raw / "e.txt").write_text("e")
    assert found(1) == want  # from the listing that is kept
    os.utime(raw / "a.txt", (1e9, 1e9))
    assert found(2) == [("raw/n/a.txt", "changed"), ("raw/n/e.txt", "created")] and found(3) == []


def test_changes_are_streamed_and_go_on_after_a_restart(spark, tmp_path):
    raw, state = tmp_path / "v/raw", str(tmp_path / "state")
    raw.mkdir(parents=True)
    listed = lambda: files.raw_files(spark, str(tmp_path / "v"))
    (raw / "a.txt").write_text("a")

    def run(done, name):
        lister = jobs.list_changes(spark, listed, state, "1 second")
        reader = jobs.change_stream(spark, state).select("rel", "change").writeStream.format("memory").queryName(name).start()
        try:
            for _ in range(120):
                time.sleep(0.5)
                if done(sorted(map(tuple, spark.table(name).collect()))):
                    return True
        finally:
            lister.stop()
            reader.stop()

    def edit(got):
        if os.path.exists(f"{state}/events/0/_SUCCESS") and not got:
            (raw / "a.txt").write_text("edited")
        return got == [("raw/a.txt", "changed")]

    assert run(edit, "one")
    (raw / "a.txt").unlink()  # while nothing runs
    assert run(lambda got: got[-1:] == [("raw/a.txt", "gone")], "two")


def test_a_failed_sweep_is_told_and_the_watch_goes_on(spark, tmp_path, capsys):
    spark.createDataFrame([("raw/a",)], "rel string").write.parquet(str(tmp_path / "in/1"))

    def broken():
        raise RuntimeError("no sweep today")

    stream = spark.readStream.schema("rel string").option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    jobs.watch(stream, broken, str(tmp_path / "queue"), str(tmp_path / "c"), once=True).awaitTermination()
    assert "no sweep today" in capsys.readouterr().out


def test_neighbours_within_a_budget(spark):
    edges = spark.createDataFrame([("a", "refines", 0, "b"), ("c", "refines", 0, "a"), ("a", "related", 0, "d")], "src string, key string, ord int, dst string")
    seeds = spark.createDataFrame([("a",)], "seed string")
    told = lambda q, **k: sorted((r.page_ref, r.hop) for r in graph.answers(seeds, edges, q, **k).collect())
    assert told("what it refines") == [("a", 0), ("b", 1)] and told("what refines it") == [("a", 0), ("c", 1)]
    assert told("anything", budget=3) == [("a", 0), ("b", 1), ("c", 1)]


def test_paths_end_before_a_page_that_repeats(spark):
    steps = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "b"), ("d", "d")], "src string, nxt string")
    seeds = spark.createDataFrame([("a",), ("d",), ("x",), ("a",)], "seed string")
    got = sorted((r.seed, r.active, tuple(r.chain)) for r in graph.paths(seeds, steps).collect())
    assert got == [("a", "c", ("b", "c"))] * 2 + [("d", "d", ()), ("x", "x", ())]


def test_a_thousand_pages_and_a_cycle_have_whole_chains(spark):
    """In log n joins; chains that join another one or run into a cycle, from every page."""
    steps = [(f"{i:04}", f"{i + 1:04}") for i in range(1000)] + [(f"m{i}", f"m{i + 1}") for i in range(4)] + [("m4", "0990")]
    steps += [(f"c{i}", f"c{(i + 1) % 7}") for i in range(7)] + [("t0", "t1"), ("t1", "c3")]
    nxt = dict(steps)

    def walked(seed):
        out = []
        while (last := out[-1] if out else seed) in nxt and nxt[last] not in [seed, *out]:
            out.append(nxt[last])
        return tuple(out)

    seeds = [*nxt, "1000"]
    df = lambda rows, schema: spark.createDataFrame(rows, schema)
    got = {r.seed: (r.active, tuple(r.chain)) for r in graph.paths(df([(x,) for x in seeds], "seed string"), df(steps, "src string, nxt string")).collect()}
    assert got == {x: ((walked(x) or (x,))[-1], walked(x)) for x in seeds}
    ends = {r.seed: (r.active, r.hops) for r in graph.chains(df([(x,) for x in seeds], "seed string"), df(steps, "src string, nxt string")).collect()}
    assert ends == {x: (a, len(c)) for x, (a, c) in got.items()}


def test_debounce_stream_is_the_batch(spark, tmp_path):
    rows = [("a", 0), ("a", 10), ("a", 20), ("a", 35), ("a", 66), ("b", 0), ("b", 30), ("z", 10_000)]
    events = spark.createDataFrame([(i, r, s) for i, (r, s) in enumerate(rows)], "seq int, rel string, s int").withColumn("ts", F.timestamp_seconds("s"))
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = jobs.debounce(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("settled").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination()
    got = sorted((r.rel, r.events) for r in spark.sql("SELECT * FROM settled").collect())
    want = sorted((r.rel, r.events) for r in logs.debounced(events, 30).collect() if r.rel != "z")
    assert got == want == [("a", 1), ("a", 4), ("b", 2)]


@pytest.fixture
def repo(tmp_path):
    root = tmp_path / "vault"
    (root / "wiki/concepts").mkdir(parents=True)
    run = lambda *a: subprocess.run(["git", "-C", str(root), "-c", "user.email=a@b", "-c", "user.name=n", *a], check=True, capture_output=True)
    run("init", "-q")

    def commit(date="2024-01-02T00:00:00Z", **pages):
        for name, text in pages.items():
            p = root / f"wiki/concepts/{name}.md"
            p.unlink() if text is None else p.write_text(text)
        run("add", "-A")
        subprocess.run(["git", "-C", str(root), "-c", "user.email=a@b", "-c", "user.name=n", "commit", "-qm", "m", f"--date={date}"], check=True, capture_output=True)
        return git.head(str(root))

    return str(root), commit


def test_git_feed_and_incremental_index(spark, repo, tmp_path):
    root, commit = repo
    first = commit(a="---\ntitle: A\n---\nx", b="---\ntitle: B\n---\ny", c="---\ntitle: C\n---\nz")
    spark.dataSource.register(git.GitPages)
    read = lambda **o: sorted((r.page_ref[-4:-3], r.date, r.deleted) for r in spark.read.format("git_pages").options(root=root, **o).load().collect())
    assert read() == [("a", "2024-01-02", False), ("b", "2024-01-02", False), ("c", "2024-01-02", False)]
    parse = Engine._records
    index = StoredIndex(spark, str(tmp_path / "index"))

    def sync():
        feed = spark.readStream.format("git_pages").options(root=root).load()
        jobs.indexed(feed, index, parse, str(tmp_path / "ck")).awaitTermination()
        return sorted((r.page_ref[-4:-3], r.title) for r in index.pages(index.version()).collect())

    assert sync() == [("a", "A"), ("b", "B"), ("c", "C")]
    commit("2024-03-04T00:00:00Z", a="---\ntitle: A2\n---\nx", b=None, c="---\ntitle: [\n---\n", d="---\ntitle: D\n---\n")
    assert read(since=first) == [("a", "2024-03-04", False), ("b", "2024-03-04", True), ("c", "2024-03-04", False), ("d", "2024-03-04", False)]
    assert len(read(since="0" * 40)) == 3
    assert sync() == [("a", "A2"), ("d", "D")]
    assert git.is_work_tree(root) and not git.is_work_tree(str(tmp_path / "none"))


def test_watch_appends_each_file_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    spark.createDataFrame([("raw/a",), ("raw/b",), ("raw/a",)], "rel string").write.parquet(str(tmp_path / "in/1"))
    stream = lambda: spark.readStream.schema("rel string").option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    sweep = lambda: spark.createDataFrame([("raw/a",)], "raw_rel string")
    for k in (1, 2):
        jobs.watch(stream(), sweep, str(tmp_path / "queue"), str(tmp_path / f"c{k}"), once=True).awaitTermination()
    assert [r.rel for r in jobs.pending(spark, str(tmp_path / "queue")).collect()] == ["raw/a"]
