"""Splitters, HTML, templates, code analysis and Column functions, with the fixtures' values and properties."""

import uuid

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fernspark.functions import code, html, scalar, splitters, templates

PARAGRAPHS = "        First paragraph comes here.\n\n        Second one follows it now.\n\n        And the third closes all.\n"
MARKDOWN = "".join(f"        # Heading {w}\n\n        Paragraph of the {w} part.\n\n" for w in ("one", "two", "three"))


def test_three_paragraphs():
    assert splitters.text_chunks(PARAGRAPHS, 40) == [x.strip() for x in PARAGRAPHS.split("\n\n")]


def test_three_headings():
    got = splitters.markdown_chunks(MARKDOWN, 40)
    assert got == [x.strip() for x in MARKDOWN.split("\n\n") if x.strip()] and len(got) == 6


@pytest.mark.parametrize("span", [(10, 15), (20, 25), (30, 35), (40, 45), (50, 55)])
@pytest.mark.parametrize("split", [splitters.text_chunks, splitters.markdown_chunks])
def test_spans(span, split):
    text = "\n\n".join(" ".join(f"w{i}" for i in range(k, k + 40)) for k in range(30))
    got = split(text, span=span)
    assert got and all(span[0] <= len(c.encode()) < span[1] for c in got)


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("ab .!?\n\t#-é́`* 1"), max_size=300), st.integers(1, 40), st.booleans())
def test_chunks_keep_all_text(text, most, markdown):
    got = (splitters.markdown_chunks if markdown else splitters.text_chunks)(text, most)
    assert all(0 < len(c) <= most and c == c.strip() for c in got)
    assert "".join("".join(got).split()) == "".join(text.split())


def test_empty_texts():
    assert splitters.text_chunks("") == [] and splitters.text_chunks(None) == [] and splitters.markdown_chunks(" \n ") == []


def test_markdown_of_html():
    assert html.to_markdown("<h1>Hello, World!</h1>") == "# Hello, World!"
    assert html.to_markdown(None) is None and html.to_markdown("") == ""
    got = html.to_markdown("<style>x</style><p>a <b>b</b> <em>c</em> <a href='/x'>y</a></p><ul><li>1<li>2</ul><pre>z\n z</pre><blockquote>q</blockquote><script>var t='</p>'</script>")
    assert got == "a **b** *c* [y](/x)\n\n* 1\n* 2\n\n```\nz\n z\n```\n\n> q"
    assert html.to_markdown("<table><tr><th>a</th><th>b|c</th></tr><tr><td>1</td><td></td></tr></table>") == "| a | b\\|c |\n| --- | --- |\n| 1 |  |"
    assert html.to_markdown("<ol><li>x<ul><li>y</li></ul></li><li>z</li></ol>") == "1. x\n  * y\n2. z"


def test_templates():
    assert templates.render("{{ x }}") == "{{ x }}"
    text = "{% for d in docs %}{{ d.t | upper }}{% if d.n and not d.o %}!{% elif d.o %}o{% else %}?{% endif %} {% endfor %}{{ x }}"
    assert templates.render(text, {"docs": [{"t": "a", "n": 1}, {"t": "b"}, {"t": "c", "o": True}], "x": 5}) == "A! B? Co 5"
    for bad, context in (("{{ y }}", {}), ("{% if x %}", {"x": 1}), ("{% what %}", {})):
        with pytest.raises(templates.TemplateError):
            templates.render(bad, context)


SOURCE = '''import os
from a.b import c


class A(Base):
    """Doc."""

    def f(self, x):
        """Doc."""
        return g(x) + len(os.path.join("a"))


def g(y): return c(y)
'''


def test_code():
    refs, defs = code.references_and_definitions(SOURCE)
    assert refs == ["Base", "c", "join", "os"] and defs == ["A", "f", "g"]
    short = code.outline(SOURCE)
    assert "return g(x)" not in short and "def f(self, x):" in short and short.count('"""Doc."""') == 2
    assert code.outline(SOURCE, 10_000) is None
    with pytest.raises(code.CodeError):
        code.outline("def (")


def test_code_chunks():
    got = code.chunks("fn main() {\n    println!(\"1\");\n}\n" * 5, "rust", 50)
    assert all(0 < len(c.encode()) <= 50 for c in got) and "".join(got) == "fn main() {\n    println!(\"1\");\n}\n" * 5
    assert code.chunks("") == [] and code.chunks("def (\n") == ["def (\n"]
    assert "".join(code.chunks(SOURCE, "python", 60)) == SOURCE and len(code.chunks(SOURCE, "python", 60)) > 2
    assert code.chunks("x = 1\ny = 2\n", least_bytes=20) == []


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first()


def test_ids(spark):
    for path, text in (("/a", "b"), ("/é", "日本"), ("", ""), ("a", "bc"), ("ab", "c")):
        want = str(uuid.UUID(bytes=uuid.uuid3(uuid.NAMESPACE_OID, path + text).bytes))
        assert one(spark, x=scalar.node_id(F.lit(path), F.lit(text))).x == want


def test_embeddables(spark):
    m = F.create_map(F.lit("meta_2"), F.lit("p2"), F.lit("meta_10"), F.lit("p10"))
    r = one(spark, s=scalar.combined_text(F.lit("c"), m), e=scalar.combined_text(F.lit("c"), F.create_map().cast("map<string,string>")), p=scalar.embeddables(F.lit("c"), m, "PerField"), b=scalar.embeddables(F.lit("c"), m, "Both"))
    assert r.s == "meta_10: p10\nmeta_2: p2\nc" and r.e == "\nc"
    assert [tuple(x) for x in r.p] == [("Chunk", "c"), ("Metadata: meta_10", "p10"), ("Metadata: meta_2", "p2")]
    assert [x.field for x in r.b] == ["Combined", "Chunk", "Metadata: meta_10", "Metadata: meta_2"]


def test_scalars(spark):
    r = one(
        spark, w=scalar.column_name_words(F.lit("Questions and Answers (code)")), p=scalar.column_name_plain(F.lit("Metadata: My-Key")), q=scalar.quoted(F.lit("it's")), i=scalar.is_identifier(F.lit("a_1")), j=scalar.is_identifier(F.lit("select")),
        k=scalar.is_identifier(F.lit("1a")), f=scalar.fenced_code(F.lit("x\n```rust\nfn a\n```\n```\nz```")), g=scalar.fenced_code(F.lit("plain")), d=scalar.debug_text(F.lit("héllo"), 3), t=scalar.trimmed(F.lit("  x y\n")), n=scalar.token_estimate(F.lit("a" * 7)),
        c=scalar.canonical_json(F.lit('{ "b":1, "a":[2, {"z":0,"y":1}]}')), s=scalar.sparse_dot(F.struct(F.array(F.lit(0), F.lit(2)).alias("indices"), F.array(F.lit(1.0), F.lit(2.0)).alias("values")), F.struct(F.array(F.lit(2), F.lit(3)).alias("indices"), F.array(F.lit(5.0), F.lit(7.0)).alias("values"))),
        z=scalar.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0))),
    )
    assert (r.w, r.p, r.q, r.i, r.j, r.k) == ("questions_and_answers", "metadata__my_key", "it''s", True, False, False)
    assert (r.f, r.g, r.d, r.t, r.n, r.c, r.s, r.z) == ("fn a\n", "plain", "hél (5)", "x y", 1, '{"a":[2,{"y":1,"z":0}],"b":1}', 10.0, None)


def test_host_kinds(spark):
    kinds = {"http://localhost:3/x": "local", "http://127.0.0.1/": "local", "http://10.1.2.3": "local", "http://172.20.0.1/": "local", "http://172.40.0.1/": "remote", "https://u:p@x.local/": "local", "http://[::1]:8/": "local", "https://a.example.org/localhost": "remote", "no url": "remote"}
    rows = spark.createDataFrame(list(kinds.items()), "u string, k string").select("k", scalar.host_kind("u").alias("got")).collect()
    assert all(r.k == r.got for r in rows)
