"""Front matter and fixtures: values, errors with their lines, and lint rules."""

import random

import pytest

from quillframe.sources import frontmatter as fm

DOC = """\
# a comment
title: "A: title # no comment"   # comment
stem: fonseca-2026-x
year: 2026
draft: true
none: ~
empty:
score: -1.50
quoted: 'it''s'
words: plain text: no
"""

CASES = [
    ("a: 1\nb: two words\n", {"a": 1, "b": "two words"}),
    ('t: "A: x # y"   # c\nn: ~\ne:\nf: -1.5\nq: \'it\'\'s\'\nb: yes\nc: TRUE\n', {"t": "A: x # y", "n": None, "e": None, "f": -1.5, "q": "it's", "b": "yes", "c": True}),
    ("list:\n  - a\n  - b: 1\n    c: 2\n  -\n    - x\n    - y\n  - [p, \"q, r\", {s: 1}]\n", {"list": ["a", {"b": 1, "c": 2}, ["x", "y"], ["p", "q, r", {"s": 1}]]}),
    ("list:\n- a\n- b\nk: v\n", {"list": ["a", "b"], "k": "v"}),
    ("a:\n  b:\n    c: 1\n  d: x\ne: 2\n", {"a": {"b": {"c": 1}, "d": "x"}, "e": 2}),
    ("n: |\n  one\n\n    two\n  three\n\nk: 1\n", {"n": "one\n\n  two\nthree\n", "k": 1}),
    ("n: >-\n  one\n  two\n\n  three\nk: 1\n", {"n": "one two\nthree", "k": 1}),
    ("n: |+\n  one\n\nk: 1\n", {"n": "one\n\n", "k": 1}),
    ("k: [a,\n  b,  # c\n  c]\nm: {x: 1,\n  y: [2]}\n", {"k": ["a", "b", "c"], "m": {"x": 1, "y": [2]}}),
    ("k: one\n  two\n  three\nm: 1\n", {"k": "one two three", "m": 1}),
    ("links:\n  - \"[[a/b]]\"\n  - [[c]]\n", {"links": ["[[a/b]]", [["c"]]]}),
    ("url: http://x.y/z\ntime: 10:20\n\"odd key\": 1\n", {"url": "http://x.y/z", "odd key": 1, "time": "10:20"}),
    ("- 1\n- x\n", [1, "x"]),
    ("", None),
    ("a: \"x\\n\\u00e9\\\"\"\n", {"a": 'x\né"'}),
    ("a: 1\na: 2\n", {"a": 2}),
]


@pytest.mark.parametrize(("text", "want"), CASES)
def test_values(text, want):
    assert fm.parse(text) == want


@pytest.mark.parametrize(("text", "line"), [
    ("a: 1\nb: [1, 2\nc: 3\n", None), ("a: 1\n  b: 2\n", 2), ("a: b: c\n", 1), ('a: "x\n', None), ("a:\n\t- b\n", 2), ("a: 1\nnot a key\n", 2), ("a: &x 1\n", 1), ("a: *x\n", 1), ("k: {a: 1\n", None), ("a: 'x' y\n", 1), ("- a\nb: 1\n", 2),
])
def test_errors_have_lines(text, line):
    with pytest.raises(fm.ParseError) as wrong:
        fm.parse(text)
    assert line is None or wrong.value.line == line


def test_agrees_with_a_full_parser_on_random_documents():
    yaml = pytest.importorskip("yaml")
    rng = random.Random(3)
    scalars = ["x", "two words", '"q: r"', "'s # t'", "12", "3.5", "true", "null", "[a, 1]", "{a: 1, b: c}", "http://a.b", "a#b", "-5", "~", "[]", "{}", '"[[x]]"']

    def block(depth, indent):
        pad = " " * indent
        if depth == 0 or rng.random() < 0.3:
            return None
        if rng.random() < 0.5:
            out = []
            for i in range(rng.randint(1, 3)):
                inner = block(depth - 1, indent + 2)
                out.append(f"{pad}k{i}:" + (f"\n{inner}" if inner else f" {rng.choice(scalars)}"))
            return "\n".join(out)
        out = []
        for _ in range(rng.randint(1, 3)):
            inner = block(depth - 1, indent + 2)
            out.append(f"{pad}- {inner.lstrip()}" if inner else f"{pad}- {rng.choice(scalars)}")
        return "\n".join(out)

    for _ in range(400):
        text = block(4, 0) or "a: 1"
        assert fm.parse(text) == yaml.safe_load(text), text


def test_pages_fields_and_errors(spark):
    page = '---\ntitle: "A"\ntags:\n  - x\n  - [[c/d]]\nmeta:\n  n: 3\n---\nBody\n---\nmore\n'
    rows = [("w/cat/a.md", page), ("w/cat/b.md", "---\na: 1\n  b: 2\n---\nBody"), ("w/cat/c.md", "no fence"), ("w/cat/d.md", "---\r\na: 1\r\n---\r\nx"), ("w/cat/e.md", "---\njust text\n---\n")]
    files = spark.createDataFrame(rows, "path string, raw string")
    got = {r.stem: r for r in fm.pages(files).selectExpr("*", "try_variant_get(fields, '$.title', 'string') AS title", "try_variant_get(fields, '$.meta.n', 'int') AS n", "to_json(fields) AS js").collect()}
    assert set(got) == {"a", "b", "d", "e"} and got["a"].category == "cat"
    assert (got["a"].title, got["a"].n, got["a"].body, got["a"].error) == ("A", 3, "Body\n---\nmore\n", None)
    assert got["b"].js == "{}" and got["b"].line == 3 and got["b"].body == "Body" and got["e"].js == "{}"
    assert [tuple(r)[::2] for r in fm.invalid(fm.pages(files)).orderBy("path").collect()] == [("w/cat/b.md", 3)]
    assert [tuple(r) for r in fm.unquoted_links(files).collect()] == [("w/cat/a.md", "tags")]


FIXTURE = """paper_stem: a-2026
paper_type: trial
title: "T"
notes: |
  long
  notes
headline_claims:
  - id: one
    importance: critical
    verbalization: |
      It works: 27% (3/11).
    relation:
      subject: "s"
      ratio: "9%"
      comparator: "c"
  - id: two
related_papers:
  - link: "[[x/y]]"
    importance: high
"""


def test_fixture_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    texts = {
        "good": FIXTURE, "bad": "a: [1\n", "kind": "fixture_type: other\n", "lacking": "title: x\n", "loud": FIXTURE.replace("critical", "loud"), "nameless": FIXTURE.replace("id: two", "location: p"),
        "sub/claims": "fixture_type: claims\nquery: q\nexpected_claims:\n  - {paper_stem: a, section: results, position: 0, importance: high}\n",
        "sub/mixed": "fixture_type: pages\nquery: q\nexpected_pages: [{paper_stem: a, importance: high}]\nexpected_claims: [{paper_stem: a, section: r, position: 0, importance: high}]\n",
        "sub/empty": "fixture_type: pages\nquery: q\n", "sub/part": "fixture_type: pages\nquery: q\nexpected_pages: [{importance: high}]\n", "list": "- 1\n", "sub/mute": "fixture_type: claims\nquery: ' '\n",
    }
    for name, text in texts.items():
        (tmp_path / f"{name}.yaml").write_text(text)
    files = fm.fixture_errors(fm.read_yaml(spark, str(tmp_path)))
    got = {r.path.split("/")[-1].removesuffix(".yaml"): r.problem for r in files.collect()}
    assert got.pop("bad").startswith("unreadable: ")
    assert got == {
        "good": None, "kind": "unknown fixture_type", "lacking": "missing field", "loud": "unknown importance", "nameless": "item without id or link", "claims": None, "mixed": "claims in a pages fixture",
        "empty": "no expected_pages", "part": "anchor lacks a field", "list": "not a mapping", "mute": "no query",
    }
    items = fm.fixture_items(files.where("problem is null and path like '%good.yaml'")).orderBy("axis", "position").collect()
    assert [(r.axis, r.position, r.id, r.importance, r.verbalization) for r in items] == [("headline_claims", 0, "one", "critical", "It works: 27% (3/11)."), ("headline_claims", 1, "two", "normal", ""), ("related_papers", 0, "[[x/y]]", "high", "")]
