"""A small collection end to end."""

import json
import subprocess

import pytest

from folioscope.engine import Engine, append_calls, as_document, as_json_lines
from folioscope.operators import search, stored


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("vault")
    e = Engine(spark, str(root))
    e.init()
    (root / "raw/n").mkdir()
    for p, t in (
        ("wiki/sources/s.md", "---\ntitle: Stub\ntags: [x]\nraw_source: '[r](../../raw/n/r.txt)'\n---\nThe weave.\n"),
        ("wiki/concepts/a.md", "---\ntitle: Old weaving\ntags: [x, y]\n---\nWeaves of threads.\n"),
        ("wiki/concepts/b.md", "---\ntitle: New weaving\nsupersedes:\n  - '[a](a.md)'\nsource:\n  - '[s](../sources/s.md)'\n---\nA weave of threads, see [a](a.md).\n"),
        ("raw/n/r.txt", "r"),
        ("raw/n/new.txt", "n"),
        ("raw/n/x.tmp", "t"),
    ):
        (root / p).write_text(t)
    e.ignore("raw/n", "*.tmp", "temporary")
    e.ignore("n", "*.tmp")
    for a in (["init", "-q"], ["config", "user.email", "a@b"], ["config", "user.name", "n"], ["add", "-A"], ["commit", "-qm", "m", "--date=2024-05-06T00:00:00Z"]):
        subprocess.run(["git", "-C", str(root), *a], check=True, capture_output=True)
    return e


def test_search(engine):
    hits = engine.search(text="weave")
    rows = hits.collect()
    assert [r.page_ref for r in rows] == ["wiki/concepts/b.md", "wiki/sources/s.md"] and rows[0].git_date == "2024-05-06" and "weave" in rows[0].snippet
    assert [r.page_ref for r in engine.search(text="weave", include_superseded=True).collect()][-1] == "wiki/sources/s.md"
    assert json.loads(as_json_lines(engine.search(kinds=("source",))).first().value)["snippet"] is None
    assert json.loads(as_document(engine.vocabulary()))[0] == {"tag": "x", "n": 2}
    drafts = engine.spark.createDataFrame([(1, "Weaveing", "", "threads")], "query_id int, title string, summary string, body string")
    assert engine.discover(drafts).first().page_ref == "wiki/concepts/b.md"
    status = engine.status().first().asDict()
    assert {k: status[k] for k in ("pages", "on_disk", "behind", "backend")} == {"pages": 3, "on_disk": 3, "behind": 0, "backend": "none"} and len(status["head"]) == 40


def test_chain_and_page(engine):
    assert [(r.seed, r.active) for r in engine.resolve(["wiki/concepts/a.md"]).collect()] == [("wiki/concepts/a.md", "wiki/concepts/b.md")]
    assert json.loads(engine.read_page("wiki/concepts/a.md", as_json=True)) == {"page_ref": "wiki/concepts/a.md", "frontmatter": {"title": "Old weaving", "tags": ["x", "y"]}, "body": "Weaves of threads.\n"}
    assert engine.resolve(["wiki/concepts/a.md"]).first().chain == ["wiki/concepts/b.md"]
    with pytest.raises(ValueError):
        engine.read_page("wiki/concepts/none.md")
    assert engine.page_get("wiki/concepts/a.md", "tags") == ["x", "y"] and engine.page_get("wiki/concepts/a.md", "none") is None
    before = engine.read_page("wiki/concepts/a.md")
    engine.page_set("wiki/concepts/a.md", "source_date", "2024-02-03T10:00z")
    engine.page_merge("wiki/concepts/a.md", "tags", ["y", "z"])
    assert engine.page_get("wiki/concepts/a.md") == {"title": "Old weaving", "tags": ["x", "y", "z"], "source_date": "2024-02-03"}
    assert engine.read_page("wiki/concepts/a.md").endswith("---\nWeaves of threads.\n")
    with pytest.raises(ValueError, match="not a date"):
        engine.page_set("wiki/concepts/a.md", "source_date", "2024-02-30")
    engine._rewrite("wiki/concepts/a.md", before)


def test_sweep(engine):
    assert [(r.raw_rel, r.reason) for r in engine.scan_raw("n").collect()] == [("raw/n/new.txt", "never_ingested")]


def test_plan_commit_and_move(engine):
    plan = {"title": "T", "pages": [{"op": "create", "title": "Fresh page", "kind": "entity", "body": "x\n", "edges": [{"key": "related", "targets": ["wiki/concepts/b.md"]}]}]}
    assert [r.line for r in engine.ingest(json.dumps(plan), dry_run=True).collect()] == ["create wiki/entities/fresh-page.md"]
    sha = engine.commit(engine.ingest(json.dumps(plan)))
    assert len(sha) == 40 and '"[New weaving](../concepts/b.md)"' in engine.read_page("wiki/entities/fresh-page.md")
    with pytest.raises(ValueError, match="target is taken"):
        engine.ingest(json.dumps(plan))
    changed = engine.move("wiki/concepts/a.md", "wiki/synthesis/c d.md")
    assert changed == ["wiki/concepts/b.md", "wiki/synthesis/c d.md"]
    assert "see [a](../synthesis/c%20d.md)" in engine.read_page("wiki/concepts/b.md")
    with pytest.raises(ValueError):
        engine.move("wiki/concepts/b.md", "wiki/synthesis/c d.md")
    assert engine.kinds() == {} and engine.place("concept", "A b") == "wiki/concepts/a-b.md"


def test_a_stored_index_is_a_search_without_one(engine, tmp_path):
    """By deltas, over several segments, merged, walked again and built anew."""
    root, spark = engine.root, engine.spark
    kept = Engine(spark, root, index=str(tmp_path / "index"))
    assert kept.status().first().pages == 0 and kept.status().first().backend == "parquet"
    run = lambda *a: subprocess.run(["git", "-C", root, *a], check=True, capture_output=True)
    same = lambda: [r.asDict() for r in kept.search(text="weave").collect()] == [r.asDict() for r in engine.search(text="weave").collect()]
    run("add", "-A")
    run("commit", "-qm", "all", "--allow-empty")
    assert same()
    first = kept.stored.version()
    assert kept.sync() == first and kept.status().first().head == first.head
    for k in range(2):
        with open(f"{root}/wiki/concepts/n{k}.md", "w") as f:
            f.write(f"---\ntitle: Weave {k}\nsupersedes: ['[s](../sources/s.md)']\n---\nbody\n")
        if k:
            subprocess.run(["rm", f"{root}/wiki/concepts/n0.md"], check=True)
        run("add", "-A")
        run("commit", "-qm", str(k))
        assert same()
    v = kept.stored.version()
    assert v.number == 2 and len(v.segments) == 3
    again = kept.sync(again=True)
    assert len(again.segments) == 1 and again.segments[0].startswith("m-") and same()  # four of like sizes
    whole = kept.sync(full=True)
    assert len(whole.segments) == 1 and whole.number == 4 and same()
    gone = kept.stored.clean(keep=1, older=0)
    assert same() and kept.stored.versions() == ["000000000004.json"] and {*v.segments, *again.segments} <= set(gone)
    assert {r.page_ref: r.superseded_by for r in kept.search(kinds=("source",), include_superseded=True).collect()} == {"wiki/sources/s.md": "wiki/concepts/n1.md"}


def _page(ref, title, deleted=False):
    return (ref, deleted, title, "", "body of " + title, [])


PAGE = "page_ref string, deleted boolean, title string, summary string, body string, supersedes array<string>"


def test_two_writers_lose_nothing(spark, tmp_path):
    """Both take the same version as theirs; the one that publishes second starts again."""
    one, two = (stored.StoredIndex(spark, str(tmp_path / "i")) for _ in range(2))
    rows = lambda *r: spark.createDataFrame(list(r), PAGE)
    base = one.sync("c0", lambda since: rows(_page("a", "first")))
    read = two.index(base).postings
    asked = []

    def feed(since):
        asked.append(since)
        if len(asked) == 1:  # meanwhile the other writer is done
            one.sync("c1", lambda since: rows(_page("b", "second")))
        return rows(_page("c", "third")) if since == "c1" else rows(_page("b", "second"), _page("c", "third"))

    v = two.sync("c2", feed)
    assert asked == ["c0", "c1"] and v.number == 2 and v.head == "c2"
    assert sorted(r.page_ref for r in two.pages(v).collect()) == ["a", "b", "c"]
    assert {r.page_ref for r in read.collect()} == {"a"}  # a reader's files stay
    assert not two._publish(v)


def test_batches_count_once_and_merges_keep_rows(spark, tmp_path):
    index = stored.StoredIndex(spark, str(tmp_path / "i"))
    want = {}
    for k in range(6):
        rows = [_page(f"p{k}", f"title {k}"), _page(f"p{k - 1}", f"new {k}", deleted=k % 2 == 0)]
        index.apply(spark.createDataFrame(rows, PAGE), "s", k)
        want |= {r[0]: r[2] for r in rows}
        if k % 2 == 0:
            want.pop(f"p{k - 1}")
    v = index.version()
    assert index.apply(spark.createDataFrame([_page("p9", "again")], PAGE), "s", 5) == v and v.batches == {"s": 5}
    assert len(v.segments) < 6 and {r.page_ref: r.title for r in index.pages(v).collect()} == want
    built = index.index(v)
    fresh = search.build_index(index.pages(v))
    key = lambda df: sorted(map(str, df.select("term", "page_ref", "dl", "title", "summary", "body", "tf").collect()))
    assert key(built.postings) == key(fresh.postings) and built.corpus.collect() == fresh.corpus.collect()


def test_calls_are_appended(spark, tmp_path):
    calls = spark.createDataFrame([("read", "1", None)], "tool string, tool_use_id string, prompt_id string")
    append_calls(calls, str(tmp_path / "log"))
    append_calls(calls, str(tmp_path / "log"))
    lines = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "log")).collect()]
    assert lines == [{"tool": "read", "tool_use_id": "1", "prompt_id": None, "agent_id": None, "agent_type": None, "duration_ms": None}] * 2
