"""Scalar functions, links, and frontmatter."""

import pytest
import yaml
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioscope.functions import columns as fn
from folioscope.functions import links, stemming, yamlcore

NAMES = st.text(alphabet="ab c()#%<>é", min_size=1, max_size=12)


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column).first()[0]


@pytest.mark.parametrize("title,slug", [("What's  New?", "whats-new"), ("--A--", "a"), ("", ""), ("x" * 70, "x" * 64), ("ab " + "c" * 70, "ab-" + "c" * 61), ("abcdefgh " + "c" * 70, "abcdefgh")])
def test_slug(spark, title, slug):
    assert one(spark, fn.slugify("t"), t=title) == slug


@pytest.mark.parametrize("value,day", [("2024-02-29", "2024-02-29"), (" 2024-02-03T10:00:00.5Z ", "2024-02-03"), ("2024-02-03 10:00+0200", "2024-02-03"), ("2023-02-29", None), ("summer", None), ("2024-02-03x", None)])
def test_dates(spark, value, day):
    assert one(spark, fn.canonical_date("v"), v=value) == day


@pytest.mark.parametrize("target,base,path", [("wiki/a/x.md", "wiki/a", "x.md"), ("wiki/a/x.md", "wiki/b", "../a/x.md"), ("wiki/a", "wiki/a", "."), ("raw/x", "wiki/a", "../../raw/x"), ("x", "", "x")])
def test_relative_path(spark, target, base, path):
    assert one(spark, fn.relative_path("t", "b"), t=target, b=base) == path
    assert links.relative(target, base) == path


@pytest.mark.parametrize("dest,folder,path", [("../b/x.md", "wiki/a", "wiki/b/x.md"), ("./x.md", "wiki/a", "wiki/a/x.md"), ("../../..", "wiki/a", ".."), ("", "wiki/a", "wiki/a"), ("x/", "wiki/a", "wiki/a/x/"), ("/x", "wiki/a", "wiki/a/x")])
def test_resolve(spark, dest, folder, path):
    assert one(spark, fn.resolve_path(F.col("d"), "f"), d=dest, f=folder) == path
    assert links.resolved(dest, folder) == path


def test_frontmatter_columns(spark):
    for text, block, body in (("---\na: 1\n---\nb", "a: 1\n", "b"), ("---\r\na: 1\r\n---\r\nb", "a: 1\r\n", "b"), ("---\n---\n", "", ""), ("x\n---\na\n---\n", "", "x\n---\na\n---\n"), ("---\na: 1", "", "---\na: 1")):
        assert one(spark, fn.frontmatter("t"), t=text) == block
        assert one(spark, fn.body("t"), t=text) == body
        assert yamlcore.split(text)[1] == body


def test_globs(spark):
    for pattern, name, hit in (("*.md", "a.md", True), ("*.md", "a.mdx", False), ("?.t[1]", "a.t[1]", True), ("a+b", "a+b", True), ("*", "a/b", False)):
        assert one(spark, F.rlike(F.col("n"), fn.glob_pattern("p")), n=name, p=pattern) is hit
    assert one(spark, fn.ignore_pattern("p"), p="*.tmp  # no") == "*.tmp"
    assert one(spark, fn.ignore_pattern("p"), p="# only") is None


@given(NAMES)
def test_percent_round_trip(name):
    assert links.percent_decode(links.percent_encode(name)) == name


def test_percent_decode_keeps_what_is_invalid():
    assert links.percent_decode("a%2G%4") == "a%2G%4"
    assert links.percent_decode("%C3%A9+") == "Ã©+"


def test_links_are_found():
    text = "[a](x.md) ![i](<p q.png>) [b [c] d](y(1).md#s%20t \"title\")\n\n    [code](n.md)\n\n```\n[f](n.md)\n```\n[e](un(closed) [g](z.md 'q')"
    found = links.scan_links(text)
    assert [(x.path, x.anchor, x.is_image) for x in found] == [("x.md", "", False), ("p q.png", "", True), ("y(1).md", "s t", False), ("z.md", "", False)]
    assert all(text[x.start : x.end] == x.dest for x in found)
    assert [x.line for x in found] == [0, 0, 0, 7]


VAULT = st.lists(st.tuples(st.sampled_from(["concepts", "sources", "entities"]), NAMES), min_size=2, max_size=4, unique=True)


def targets(pages):
    import posixpath

    return {(p, links.resolved(x.path, posixpath.dirname(p))) for p, t in pages.items() for x in links.scan_links(t)}


@settings(max_examples=60, deadline=None)
@given(VAULT, NAMES)
def test_a_move_keeps_every_target(vault, name):
    refs = [f"wiki/{f}/n{n.strip()}.md" for f, n in vault]
    if len(set(refs)) < len(refs) or any(".." in r for r in refs):
        return
    text = lambda p: "\n".join(f"- [x]({links.percent_encode(links.relative(r, p.rsplit('/', 1)[0]))})" for r in refs) + "\n\n    [frozen](x.md)\n"
    pages = {r: text(r) for r in refs}
    old, new = refs[0], f"wiki/moved/m{name.strip()}.md"
    moved = {new if r == old else r: links.retargeted(t, r, old, new) for r, t in pages.items()}
    follow = lambda r: new if r == old else r
    assert targets(moved) == {(follow(a), follow(b)) for a, b in targets(pages)}
    assert all(t.endswith("\n\n    [frozen](x.md)\n") for t in moved.values())


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="[]()ab <>#%\n", max_size=40))
def test_normalizing_twice_changes_nothing(text):
    once = links.normalized_links(text)
    assert links.normalized_links(once) == once


def test_yaml_is_of_version_1_2():
    got = yamlcore.values("---\na: yes\nb: on\nc: 2024-01-02\nd: true\ne: 0x10\nf: ~\ng: 1e3\n---\n")
    assert got == {"a": "yes", "b": "on", "c": "2024-01-02", "d": True, "e": 16, "f": None, "g": 1000.0}
    with pytest.raises(yaml.YAMLError):
        yamlcore.values("---\na: 1\na: 2\n---\n")
    assert yamlcore.values("---\n- x\n---\n") == {} and yamlcore.values("no") == {}


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=30), st.one_of(st.text(max_size=20), st.lists(st.text(max_size=8), max_size=3), st.booleans(), st.integers()))
def test_set_keeps_the_rest(body, value):
    text = "---\ntitle: T  # note\nlist:\n  - a\nlast: 'x'\n---\n" + body
    out = yamlcore.set_key(text, "list", value)
    assert out.endswith("\nlast: 'x'\n---\n" + body) and out.startswith("---\ntitle: T  # note\n")
    assert yamlcore.values(out)["list"] == value
    assert yamlcore.values(yamlcore.set_key(text, "new", value)) == {"title": "T", "list": ["a"], "last": "x", "new": value}


def test_merge_appends_what_is_new():
    out = yamlcore.merge_key("---\nt: [a, a, b]\n---\nx", "t", ["b", "c"])
    assert yamlcore.values(out)["t"] == ["a", "a", "b", "c"]
    assert yamlcore.set_key("x", "a", "[l](m)") == '---\na: "[l](m)"\n---\nx'


def test_ascii_slug():
    assert stemming.ascii_slug("Crème Brûlée!") == "creme-brulee"
    assert stemming.ascii_slug("東京") == ""
    assert stemming.ascii_slug("a" * 30 + " " + "b" * 40) == "a" * 30
