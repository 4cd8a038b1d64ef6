"""One object over a collection in a folder: every command as a method on DataFrames."""

from __future__ import annotations

import json
import os
import re
import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import columns as fn
from .functions import links, stemming, yamlcore
from .operators import changes, graph, logs, rawsweep, search, stored, tags
from .plans import ingest
from .sources import files, git
from .sources.session import cut
from .streaming import jobs

#: How JSON lines of hits, sweeps and tool calls name their fields.
HIT_FIELDS = ("page_ref", "title", "score", "tags", "kind", "source_date", "git_date", "summary", "volatility", "superseded_by", "snippet")
LOG_FIELDS = ("tool", "tool_use_id", "prompt_id", "agent_id", "agent_type", "duration_ms")


class Engine:
    """A collection: ``wiki/<folder>/<file>.md`` pages and ``raw/`` files below a root that
    every executor reaches; with a git repository, dates and deltas come from its history.

    ``index``: a folder for a stored index, that searches bring up to HEAD and read; without
    one each search builds its own."""

    def __init__(self, spark: SparkSession, root: str, analyzer=stemming.stemmed_tokens, index: str | None = None):
        self.spark, self.root, self.analyzer = spark, root.rstrip("/"), analyzer
        self.stored = stored.StoredIndex(spark, index, analyzer) if index else None
        spark.dataSource.register(git.GitPages)
        spark.dataSource.register(git.GitRaw)

    # -- reading

    def texts(self) -> DataFrame:
        """(page_ref, text) of the working tree."""
        return files.disk_pages(self.spark, self.root)

    def committed(self, since: str = "") -> DataFrame:
        """(page_ref, date, content, deleted) as of HEAD."""
        return self.spark.read.format("git_pages").options(root=self.root, since=since).load()

    def _view(self, texts: DataFrame, dates: DataFrame | None, mode: str) -> DataFrame:
        parsed = files.records(texts, mode)
        dated = parsed.join(dates, "page_ref", "left") if dates is not None else parsed.withColumn("git_date", F.lit(None).cast("string"))
        return graph.with_superseded_by(dated, files.record_edges(parsed))

    def pages(self, committed: bool = True) -> DataFrame:
        """Records with dates and successors: of history, malformed pages left out, or of the
        working tree, where the first malformed page is an error."""
        if committed and git.is_work_tree(self.root):
            feed = self.committed().where("NOT deleted")
            return self._view(feed.select("page_ref", F.col("content").alias("text")), feed.select("page_ref", F.when(F.col("date") != "", F.col("date")).alias("git_date")), "DROPMALFORMED")
        return self._view(self.texts(), None, "FAILFAST")

    def edges(self) -> DataFrame:
        return files.record_edges(files.records(self.texts(), "FAILFAST"))

    def read_page(self, ref: str, as_json: bool = False) -> str:
        """P-12: a page's text, or its reference, frontmatter and body in JSON."""
        page = self.texts().where(F.col("page_ref") == ref)
        if as_json:
            page = files.records(page, "FAILFAST").select(F.concat(F.lit('{"page_ref":'), F.to_json(F.array("page_ref")).substr(F.lit(2), F.length("page_ref") + 2), F.lit(',"frontmatter":'), "frontmatter", F.lit(',"body":'), F.regexp_replace(F.to_json(F.struct("body")), r'^\{"body":|\}$', ""), F.lit("}")))
        else:
            page = page.select("text")
        found = page.first()
        if found is None:
            raise ValueError(f"no such page: {ref}")
        return found[0]

    def page_get(self, ref: str, key: str | None = None):
        """P-10: a page's frontmatter, or one value of it (None if there is none)."""
        found = yamlcore.values(self.read_page(ref))
        return found if key is None else found.get(key)

    def page_set(self, ref: str, key: str, value) -> None:
        """S-16: set a value, all else of the page byte for byte; a source_date must be a date."""
        self._rewrite(ref, yamlcore.set_key(self.read_page(ref), key, self._dated(key, value)))

    def page_merge(self, ref: str, key: str, values: list) -> None:
        """O-05: append to a list what it lacks."""
        self._rewrite(ref, yamlcore.merge_key(self.read_page(ref), key, values))

    def _dated(self, key: str, value):
        if key != "source_date":
            return value
        date = self.spark.range(1).select(fn.canonical_date(F.lit(str(value)))).first()[0]
        if date is None:
            raise ValueError(f"not a date: {value}")
        return date

    def _rewrite(self, ref: str, text: str) -> None:
        ingest.write_pages(self.spark.createDataFrame([(ref, text)], "page_ref string, text string"), self.root)

    # -- search

    def _changed(self, since: str) -> DataFrame:
        """What StoredIndex.sync is fed with: records of what changed since a commit."""
        feed = cut(self.committed(since))  # the history is read once
        live = feed.where("NOT deleted").select("page_ref", F.col("content").alias("text"), F.when(F.col("date") != "", F.col("date")).alias("git_date"))
        records = self._records(live).withColumn("there", F.lit(True))
        return feed.select("page_ref").distinct().join(records, "page_ref", "left").withColumn("deleted", F.col("there").isNull()).drop("there")

    @staticmethod
    def _records(live: DataFrame) -> DataFrame:
        """Records, with the pages they supersede, of those of (page_ref, text, git_date) that parse."""
        parsed = files.records(live.select("page_ref", "text"), "DROPMALFORMED")
        links_of = files.record_edges(parsed).where("key = 'supersedes'").groupBy(F.col("src").alias("page_ref")).agg(F.sort_array(F.collect_set("dst")).alias("supersedes"))
        records = parsed.join(live.select("page_ref", "git_date"), "page_ref").join(links_of, "page_ref", "left")
        return records.withColumn("supersedes", F.coalesce("supersedes", F.array().cast("array<string>")))

    def sync(self, again: bool = False, full: bool = False) -> stored.Version:
        """W-07, W-08: bring the stored index up to HEAD; ``again`` walks the last range even
        at HEAD, ``full`` builds anew.  A version whose commit is gone is built anew too."""
        now = self.stored.version()
        lost = now is not None and not git.known(self.root, now.head)
        return self.stored.sync(git.head(self.root), self._changed, again, full or lost)

    def follow(self, checkpoint: str, **how):
        """W-07: the stored index fed by the stream of the repository's history."""
        feed = self.spark.readStream.format("git_pages").options(root=self.root).load()
        return jobs.indexed(feed, self.stored, self._records, checkpoint, **how)

    def _current(self, indexed: bool = True) -> tuple[DataFrame, search.Index | None]:
        if self.stored is not None:
            v = self.sync()
            return self.stored.pages(v), self.stored.index(v) if indexed else None
        view = self.pages()
        return view, None

    def search(self, **query) -> DataFrame:
        """Hits with snippets where the query has text."""
        q = search.Query(**query)
        ranked = bool(q.text.strip()) or q.expression is not None
        view, index = self._current(ranked)
        hits = search.search(view, index, q, self.analyzer)
        if not ranked:
            return hits.withColumn("snippet", F.lit(None).cast("string"))
        leaves = [search.Phrase(w) for w in search.words_of(q.text)] if q.expression is None else search._leaves(q.expression)
        met = hits.join(view.select("page_ref", "body"), "page_ref")
        return stemming.with_snippets(met, [p.text for p in leaves], [p.prefix for p in leaves]).drop("body").orderBy(F.desc("score"), "page_ref")

    def discover(self, drafts: DataFrame, **how) -> DataFrame:
        """Candidates for drafts (query_id, title, summary, body)."""
        view, index = self._current()
        terms = fn.discovery_terms(*[F.coalesce(c, F.lit("")) for c in ("title", "summary", "body")])
        asked = drafts.select("query_id", "title", self.analyzer(F.array_join(terms, " ")).alias("terms"))
        return search.discover(view, index, asked, analyzer=self.analyzer, **how).orderBy("query_id", "rank")

    def vocabulary(self) -> DataFrame:
        return tags.vocabulary(tags.page_tags(self._current(False)[0]))

    def status(self) -> DataFrame:
        """A-04: of the index as it is, not brought up to HEAD first: pages, pages on disk, how
        many it lacks at least, and its size, kind, layout and commit."""
        v = self.stored.version() if self.stored is not None else None
        pages = self.stored.pages(v) if v is not None else self.pages() if self.stored is None else self.texts().where("false")
        size = self.stored.bytes() if self.stored is not None else 0
        own = {"bytes": F.lit(size), "backend": F.lit("parquet" if self.stored is not None else "none"), "version": F.lit(stored.SCHEMA), "head": F.lit(v.head if v is not None else "" if self.stored is not None else git.head(self.root))}
        return tags.status(pages, self.texts()).withColumns(own)

    def resolve(self, seeds: list[str]) -> DataFrame:
        """G-04: (seed, active, chain): the active end of each page's chain, in the working
        tree, and the pages after the seed up to it, none for a current page."""
        successors = self.edges().where("key = 'supersedes'").select(F.col("dst").alias("src"), F.col("src").alias("nxt"))
        return graph.paths(self.spark.createDataFrame([(s,) for s in seeds], "seed string"), successors)

    # -- writing

    def place(self, kind: str, title: str) -> str:
        return self.spark.range(1).select(fn.place(F.lit(kind), F.lit(title))).first()[0]

    def kinds(self) -> dict[str, str]:
        """I-09: by kind the folders that are not canonical."""
        own = self.texts().select(F.element_at(F.split("page_ref", "/"), 2).alias("f")).distinct()
        found = own.where(~F.col("f").isin(*fn.FOLDERS.values())).select("f", F.regexp_replace("f", "s$", "").alias("k")).collect()  # one row a folder
        return {r.k: r.f for r in sorted(found)}

    def move(self, old: str, new: str) -> list[str]:
        """G-13, K-02: move a page, with its links and those at it; changed pages, sorted.

        What is to be written is fixed before the first file changes, and the old file goes
        last, so that a move that broke off can be run again once the new file is removed."""
        before = self.texts()
        after = links.move(before, old, new)
        changed = changes.classified(before, after).where("change <> 'removed'")
        written = cut(after.join(changed, "page_ref", "left_semi"))
        refs = sorted(r.page_ref for r in written.select("page_ref").collect())
        ingest.write_pages(written, self.root)
        if old.startswith("wiki/"):
            os.remove(os.path.join(self.root, old))
        return refs

    def ingest(self, plan: str, dry_run: bool = False) -> DataFrame:
        """Validate a plan in JSON and write its pages; the manifest, or the lines of a dry run."""
        decoded = ingest.decode(self.spark.createDataFrame([(0, plan)], "plan_id int, value string"))
        texts, kinds = self.texts(), self.kinds()
        old = sorted(f for k, f in kinds.items() if f in fn.FOLDERS and f != fn.FOLDERS[f])
        if old:
            raise ValueError(f"folders of kinds must be named in the plural; move the pages of {', '.join('wiki/' + f for f in old)} first")
        existing = texts.join(files.records(texts).select("page_ref", "title"), "page_ref")
        problems = ingest.errors(decoded, existing, self.root, kinds).first()
        if problems:
            raise ValueError(f"invalid plan: {problems.errors}")
        if dry_run:
            return ingest.described(ingest.planned_pages(decoded), kinds)
        resolved = cut(ingest.resolved(decoded, existing, kinds))
        made = ingest.manifest(resolved, decoded, kinds)
        rows = made.collect()  # one plan
        ingest.write_pages(resolved.withColumnRenamed("target", "page_ref"), self.root)
        return self.spark.createDataFrame(rows, made.schema)

    def commit(self, manifest: DataFrame) -> str:
        """K-08, I-08: the evidence gate again, then one commit of the manifest's paths."""
        row = manifest.select(fn.manifest_paths().alias("paths"), fn.commit_message().alias("message"), "manifest.raw_source").first()
        if row.raw_source:
            staged = self.spark.createDataFrame([(row.raw_source, p) for p in row.paths if p.startswith("wiki/")], "raw string, page_ref string")
            gaps = graph.evidence_gaps(staged, self.edges()).collect()
            if gaps:
                raise ValueError("; ".join(f"{g.page_ref}: {g.problem}" for g in gaps))
        run = lambda *a: subprocess.run(["git", "-C", self.root, *a], check=True, capture_output=True)
        run("add", "--", *[p for p in row.paths if os.path.exists(os.path.join(self.root, p))])
        run("commit", "-m", row.message)
        return git.head(self.root)

    # -- inbox

    def scan_raw(self, folder: str = "") -> DataFrame:
        """I-10 over the files on disk; dates and dirt from git where there is a repository."""
        raw = rawsweep.scoped(files.raw_files(self.spark, self.root).select("raw_rel"), folder)
        if git.is_work_tree(self.root):
            told = self.spark.read.format("git_raw").options(root=self.root).load()
            told = told.groupBy("raw_rel").agg(F.max("date").alias("last_commit_date"), F.bool_or("dirty").alias("dirty"))  # R-08, R-09
            raw = raw.join(told, "raw_rel", "left")
            dates = self.committed().select("page_ref", F.col("date").alias("git_date"))
        else:
            raw = raw.withColumns({"last_commit_date": F.lit(""), "dirty": F.lit(False)})
            dates = self.spark.createDataFrame([], "page_ref string, git_date string")
        raw = raw.select("raw_rel", F.coalesce("last_commit_date", F.lit("")).alias("last_commit_date"), F.coalesce("dirty", F.lit(False)).alias("dirty"))
        return rawsweep.sweep(raw, files.policies(self.spark, self.root), rawsweep.back_pointers(self.edges()), dates)

    def ignore(self, folder: str, pattern: str, comment: str = "") -> None:
        """K-12: add a pattern to a folder's policy, once."""
        if re.search(r"[/!]|\*\*", pattern):
            raise ValueError(f"unsupported pattern: {pattern}")
        path = os.path.join(self.root, "raw", folder.removeprefix("raw/"), ".ingestignore")
        have = open(path, encoding="utf-8").read().splitlines() if os.path.exists(path) else []
        if pattern not in [x.split("#")[0].rstrip() for x in have]:
            with open(path, "a", encoding="utf-8") as f:
                f.write(f"{pattern}  # {comment}\n" if comment else f"{pattern}\n")

    def raw_events(self, state: str, interval: str = "2 seconds") -> DataFrame:
        """W-01: a stream of (rel, change, ts): files below ``raw`` that were created, changed
        or are gone, from listings kept in ``state``; what is there at first is no event.  The
        query that lists goes on with the session's other streams."""
        jobs.list_changes(self.spark, lambda: files.raw_files(self.spark, self.root), state, interval)
        return jobs.change_stream(self.spark, state)

    def watch(self, queue: str, checkpoint: str, events: DataFrame | None = None, **how):
        """W-02 to W-06: settled files that a sweep finds eligible go to the queue."""
        settled = jobs.debounce(events if events is not None else self.raw_events(f"{checkpoint}/changes"))
        return jobs.watch(settled, self.scan_raw, queue, f"{checkpoint}/watch", **how)

    def init(self) -> None:
        """K-13: the folders of a new collection."""
        for folder in (*(f"wiki/{f}" for f in fn.FOLDERS.values()), "raw"):
            os.makedirs(os.path.join(self.root, folder), exist_ok=True)

    # -- logs

    tool_stats = staticmethod(logs.tool_histogram)
    render = staticmethod(logs.rendered)


def as_json_lines(df: DataFrame, fields: tuple[str, ...] = HIT_FIELDS) -> DataFrame:
    """K-10, K-14: one JSON line a row, with explicit nulls; fields that the rows lack are null."""
    cols = [F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in fields]
    return df.select(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}).alias("value"))


def append_calls(calls: DataFrame, path: str) -> None:
    """K-10: tool calls at the end of a log of JSON lines."""
    as_json_lines(calls, LOG_FIELDS).write.mode("append").text(path)


def as_document(df: DataFrame) -> str:
    """Two-space JSON of a bounded result."""
    return json.dumps([json.loads(r.value) for r in as_json_lines(df, tuple(df.columns)).collect()], indent=2, ensure_ascii=False)
