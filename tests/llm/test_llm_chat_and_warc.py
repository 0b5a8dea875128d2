"""op8 round trips and layouts; op2 records."""

from __future__ import annotations

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from holdfast.llm.op2_warc_derivatives import ENTITIES, derive, page_text, read_responses, responses_from_pages, write_records
from holdfast.llm.op8_chat_formatting import as_records, canonical_turns, escape, format_chats, outline, query, read_loss, read_turns, spelt, unescape, with_template

TRICKY = ["", "plain", "</s>", "[INST]", "[/INST]", "~", "~1", "~~0</s>~", "</s>[INST] ok [/INST]", "[INST[INST]]", "</</s>s>", "é~2\n[/INST", "𝄞</s>𝄞"]


def test_escapes_are_reversible(spark):
    df = spark.createDataFrame([(t,) for t in TRICKY], "t string").select("t", escape(F.col("t")).alias("e"), unescape(escape(F.col("t"))).alias("u"))
    for x in df.collect():
        assert x.u == x.t
        assert not any(c in x.e for c in ("</s>", "[INST]", "[/INST]"))


def test_layouts_and_readback(spark):
    records = [
        ({"messages": [{"role": "user", "content": TRICKY[8]}, {"role": "assistant", "content": TRICKY[7]}, {"role": "tool~", "content": None}]},
         "messages", [("user", TRICKY[8]), ("assistant", TRICKY[7]), ("tool~", "")]),
        ({"messages": []}, "messages", []),
        ({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "𝄞a"}, {"from": "x", "value": "z"}]},
         "conversations", [("user", "q"), ("assistant", "𝄞a"), ("x", "z")]),
        ({"prompt": "p", "completion": None}, "prompt", [("user", "p"), ("assistant", "")]),
        ({"completion": "c</s>", "prompt": "p"}, "prompt", [("user", "p"), ("assistant", "c</s>")]),
        ({"system": "s", "prompt": "p", "response": "r"}, "system_prompt", [("system", "s"), ("user", "p"), ("assistant", "r")]),
        ({"instruction": "i", "input": "", "output": "o"}, "instruction", [("user", "i"), ("assistant", "o")]),
        ({"instruction": "i", "input": "more", "output": "o"}, "instruction", [("user", "i\nmore"), ("assistant", "o")]),
        ({"instruction": "i", "output": "5"}, "instruction", [("user", "i"), ("assistant", "5")]),
    ]
    rows = [(k, json.dumps(r), 1, 2) for k, (r, _, _) in enumerate(records)]
    rows += [(100, '{"question":"q","answer":"a"}', 1, 2), (101, "not json", 1, 2), (102, None, 1, 2), (103, '{"prompt":{"text":"p"},"completion":"c"}', 1, 2)]
    df = spark.createDataFrame(rows, "id long, record string, loss int, extra int")
    got = {x.id: x for x in format_chats(df).select(
        "id", "layout", "turns", "formatted", "loss_mask", "extra", read_turns(F.col("formatted")).alias("back"), read_loss(F.col("formatted"), F.col("loss_mask")).alias("kept")).collect()}
    for k, (_, layout, turns) in enumerate(records):
        x = got[k]
        assert x.layout == layout and [tuple(t) for t in x.turns] == turns == [tuple(t) for t in x.back]
        assert x.kept == "".join(t for r, t in turns if r == "assistant")
        assert sum(m.chars for m in x.loss_mask) == len(x.formatted)
    for k in (100, 101, 102, 103):
        assert got[k].layout is None and got[k].formatted is None and got[k].kept is None
    assert format_chats(df.limit(0)).count() == 0


def test_conversation_rows(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (2, 0, "system", "s"), (2, 1, "user", None), (2, 2, "assistant", "x"), (3, 0, "assistant", "x"),
            (3, 0, "assistant", "x"), (3, None, None, "n"), (None, 0, "user", "u"), (4, 0, "user", "q"), (4, 1, "assistant", "a"), (4, 2, "user", "q2")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {x.conv_id: x for x in canonical_turns(as_records(df)).collect()}
    assert [tuple(t) for t in got[1].turns] == [("user", "a"), ("assistant", "b")] and got[1].layout == "prompt"
    assert [tuple(t) for t in got[2].turns] == [("system", "s"), ("user", ""), ("assistant", "x")] and got[2].layout == "system_prompt"
    assert [tuple(t) for t in got[3].turns] == [("", "n"), ("assistant", "x"), ("assistant", "x")] and got[3].layout == "messages"
    assert got[4].layout == "conversations" and [t.role for t in got[4].turns] == ["user", "assistant", "user"]
    assert [tuple(t) for t in got[None].turns] == [("user", "u")]
    whole = with_template(canonical_turns(as_records(df))).where("conv_id = 1").first()
    assert whole.formatted == "[INST]user[/INST]a</s>[INST]assistant[/INST]b</s>"


def test_outline_keeps_field_paths(spark):
    cases = [
        (json.dumps({"messages": [{"role": "a", "content": 'q" : \\ {'}, {"role": "b", "content": "x,:]"}]}), '{"messages": [{"role": "", "content": ""}]}'),
        ('{"a":"\\\\","b" : [1,"x", null, {"c":"d"}]}', '{"a":"","b" : [1,"", null, {"c":""}]}'),
        (json.dumps({"prompt": "\\n" * 100_000, "completion": None}), '{"prompt": "", "completion": null}'),
    ]
    for x in spark.createDataFrame(cases, "r string, want string").select("want", outline(F.col("r")).alias("got")).collect():
        assert x.got == x.want


def test_texts_beyond_a_variant(spark):
    """A message of over 20 million characters keeps its turns, like a short one."""
    n = 6_700_000
    long = F.repeat(F.concat(F.lit('a\\n'), F.substring(F.col("id").cast("string"), 1, 1)), n)
    for before, after, layout, want in (
            ('{"prompt":"q","completion":"', '"}', "prompt", [("user", 1), ("assistant", 3 * n)]),
            ('{"messages":[{"role":"user","content":"q"},{"role":"tool","content":"', '"},{"role":"assistant","content":null}]}', "messages", [("user", 1), ("tool", 3 * n), ("assistant", 0)]),
            ('{"conversations":[{"from":"human","value":"', '"}]}', "conversations", [("user", 3 * n)]),
            ('{"prompt":"\\q","completion":"', '"}', None, None),
            ('{"question":"q","answer":"', '"}', None, None)):
        records = spark.range(0, 1, 1, 1).select(F.concat(F.lit(before), long, F.lit(after)).alias("record"))
        got = canonical_turns(records).select("layout", F.expr("transform(turns, t -> struct(t.role, length(t.text)))").alias("turns")).first()
        assert got.layout == layout and (got.turns and [tuple(t) for t in got.turns]) == want


def test_numbers_are_spelt_alike_in_records_of_any_size(spark):
    numbers = ["1.0", "1.50", "-0", "1e5", "12345678901234567890123.4500", "1E-400", "-7", "0.10", "true"]
    pad = F.repeat(F.lit("x1, 2: "), 3_000_000)
    for large in (False, True):
        for shape in ('{"prompt":%s,"completion":"\\\\\\": 5, ', '{"messages":[{"role":"user","content": %s }, {"role":7,"content":"\\\\\\": 5, '):
            end = '"}' if shape.startswith('{"p') else '"}]}'
            rows = spark.createDataFrame([(n, shape % n) for n in numbers], "n string, head string").coalesce(1)
            if large:
                rows = rows.where("n IN ('1.50', '12345678901234567890123.4500')")
            made = rows.select("n", F.concat("head", pad if large else F.lit("[1, 2"), F.lit(end)).alias("record"))
            got = canonical_turns(made).select("n", F.col("turns")[0]["text"].alias("text"), F.col("turns")[1]["role"].alias("role"), F.substring(F.col("turns")[1]["text"], 1, 9).alias("next")).collect()
            assert len(got) == (2 if large else len(numbers))
            for x in got:
                assert x.text == x.n and x.role in ("assistant", "7") and x.next == ('\\": 5, x1' if large else '\\": 5, [1')


def test_what_is_no_json_number_stays_no_json(spark):
    bad = ["01", "1.", ".5", "1.2.3", "--1", "1e", "+1", "1 2", "0x1", "1_0"]
    df = spark.createDataFrame([(f'{{"prompt":{x},"completion":"c 1"}}',) for x in bad] + [(None,), ("",), ("5",), ("[1,2]",)], "record string")
    assert canonical_turns(df).where("layout IS NOT NULL").count() == 0
    kept = spark.createDataFrame([('{"a": [1, -2.5e3,{"b" :"3, 4"}], "5": 6}',)], "record string").select(spelt(F.col("record")).alias("r")).first()
    assert kept.r == '{"a": ["1", "-2.5e3",{"b" :"3, 4"}], "5": "6"}'


def test_no_python_in_the_plan(spark, capsys):
    query(spark, "/root/testdata/sf0.001").explain()
    plan = capsys.readouterr().out
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "ExistingRDD"))


PAGE = """<!DOCTYPE html><html><head><title>A &amp; b
 c</title><style>p{}</style></head><body><script>var t="</p>";</script><!-- no --><nav><a href="/x">One</a></nav>
<h1>Größe</h1><p>first   line<br>second&nbsp;line &lt;tag&gt;</p><SCRIPT >x</SCRIPT ><b>bold</b>er</body></html>"""


def parse(record: str):
    head, block = record.split("\r\n\r\n", 1)
    lines = head.split("\r\n")
    assert lines[0] == "WARC/1.1" and block.endswith("\r\n\r\n")
    return dict(x.split(": ", 1) for x in lines[1:]), block[:-4]


def test_records(spark):
    df = spark.createDataFrame([(1, "http://e.org/", PAGE, 5), (2, None, None, 5), (3, "u", "", 5), (None, "v", "just text < 5", 5), (1, "http://e.org/", PAGE, 5)],
                               "page_id long, url string, html string, block int")
    responses = responses_from_pages(df)
    rows = derive(responses).collect()
    assert len(rows) == 10
    source = {x.record_id: x for x in responses.collect()}
    for x in rows:
        head, block = parse(x.record)
        body = block.encode()
        assert head["WARC-Refers-To"] == x.refers_to and head["WARC-Type"] == x.warc_type and head["WARC-Record-ID"] == x.record_id
        assert int(head["Content-Length"]) == len(body) == x.content_length
        assert head["WARC-Block-Digest"] == "sha256:" + hashlib.sha256(body).hexdigest()
        s = source[x.refers_to]
        assert head["WARC-Target-URI"] == s.target_uri and x.source_digest == "sha256:" + hashlib.sha256(s.body.encode()).hexdigest()
        if x.warc_type == "metadata":
            assert f"source-payload-digest: {s.payload_digest}\r\n" in block and "source-http: HTTP/1.1 200 OK\r\n" in block
            assert f"source-http: Content-Length: {len(s.body.encode())}\r\n" in block
            twin = next(y for y in rows if y.refers_to == x.refers_to and y.warc_type == "conversion")
            assert f"conversion: {twin.record_id}\r\n" in block
    text = next(parse(x.record)[1] for x in rows if x.id == 1 and x.warc_type == "conversion")
    assert text == "One\nGröße\nfirst line\nsecond line <tag>\nbolder"
    about = next(parse(x.record)[1] for x in rows if x.id == 1 and x.warc_type == "metadata")
    assert "title: A & b c\r\n" in about and "links: 1\r\n" in about
    assert derive(responses.limit(0)).count() == 0
    assert [parse(x.record)[1] for x in rows if x.id is None and x.warc_type == "conversion"] == ["just text < 5"]


def test_files_round_trip(spark, tmp_path):
    header = "HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nX-Source: a\r\n"
    raw = ""
    for k, body in enumerate((PAGE, "", "<p>x</p>\r\n\r\ny")):
        block = header + "\r\n" + body
        raw += f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:{k}>\r\nWARC-Target-URI: http://e/{k}\r\nWARC-Date: 2020-01-01T00:00:00Z\r\n"
        raw += f"WARC-Block-Digest: sha1:B{k}\r\nWARC-Payload-Digest: sha1:P{k}\r\nContent-Length: {len(block.encode())}\r\n\r\n{block}\r\n\r\n"
    raw = "WARC/1.1\r\nWARC-Type: warcinfo\r\nContent-Length: 0\r\n\r\n\r\n\r\n" + raw
    path = tmp_path / "a.warc"
    path.write_bytes(raw.encode())
    responses = read_responses(spark, str(path))
    got = {x.record_id: x for x in responses.collect()}
    assert len(got) == 3 and all(x.complete for x in got.values())
    assert got["<urn:uuid:0>"].body == PAGE and got["<urn:uuid:2>"].body == "<p>x</p>\r\n\r\ny" and got["<urn:uuid:1>"].payload_digest == "sha1:P1"
    derived = derive(responses)
    about = [parse(x.record)[1] for x in derived.where("warc_type = 'metadata'").collect()]
    assert all("source-http: X-Source: a\r\n" in a for a in about) and any("source-block-digest: sha1:B2\r\n" in a for a in about)
    out = str(tmp_path / "out")
    write_records(derived, out)
    written = "".join(p.read_bytes().decode() for p in sorted((tmp_path / "out").glob("part-*")))
    assert written.count("WARC-Type: conversion\r\n") == 3 and sorted(x.record for x in derived.collect())[0] in written


def test_pages_without_head_end_and_markup_in_comments(spark):
    cases = [
        ("<html><head><title>T</title><body><p>text</p>", "text"),
        ('<html><head lang="x">\n<meta charset="utf-8"><TITLE>a <b> c</TITLE ><link rel=x><style>p{}</style><script>"<p>"</script><p>one</p><p>two</p>', "one\ntwo"),
        ("<head><title>T</title></head><body>text</body>", "text"),
        ("<head><!-- </head> --><title>T</title></head>text", "text"),
        ("<p>a</p><!-- <script> --><p>b</p>", "a\nb"),
        ("<p>a</p><!-- <head> <style> --><p>b</p>", "a\nb"),
        ("<p>a</p><script>if (x) { y = '<!--' }</script><p>b</p>", "a\nb"),
        ("<header>h</header><p>a", "h\na"),
        ("<head><meta name=d content='" + "x" * 100_000 + "'>" + "<link rel=y> " * 20_000 + "<body>t", "t"),
    ]
    df = spark.createDataFrame(cases, "html string, want string")
    for x in df.select("html", "want", page_text(F.col("html")).alias("got")).collect():
        assert x.got == x.want, x.html[:200]


def test_character_references(spark):
    from html import unescape as standard

    from holdfast.llm.op2_warc_derivatives import entities, page_title

    same = ["a &#8217; b", "&eacute;t&eacute;", "&#x41;&#X3b1;&#0066;", "&amp;#39; &amp;amp; &amp;lt;", "&#39;&apos;&quot;&copy;", "&#128512;&#x1F600;", "&#150;&#x93;q&#148;",
            "&NotEqualTilde; &nosuchname; & &; &# &#; &#x; &#xZ; AT&T;", "&#66 x &#x42y", "&#0; &#xD800; &#1114112; &#99999999999999999999;", "&#65279;|", "a&b&&amp", "x &lt; y &gt; z &hellip;",
            "&Aacute;&aacute;&Abreve;&zwnj;", "&ampx; &lt1;", ""]
    own = [("&nbsp;|&#160;|&#xA0;", " | | "), ("&#13;&#10;", "\r\n"), ("&amp no end", "&amp no end"), (None, None)]
    cases = [(t, standard(t)) for t in same if "&b&&amp" not in t and "&ampx" not in t] + own + [("a&b&&amp", "a&b&&amp"), ("&ampx; &lt1;", "&ampx; &lt1;")]
    df = spark.createDataFrame(cases, "t string, want string")
    for x in df.select("t", "want", entities(F.col("t")).alias("got"), page_title(F.concat(F.lit("<title>"), "t", F.lit("</title>"))).alias("title")).collect():
        assert x.got == x.want, x.t
    # a text with other references beside the usual ones reads the usual ones alike
    usual = "".join(name for name, _ in ENTITIES)
    got = spark.createDataFrame([(usual, usual + "&eacute;")], "a string, b string").select(entities(F.col("a")), entities(F.col("b"))).first()
    assert got[1] == got[0] + "é" and got[0] == "".join(c for _, c in ENTITIES)
    page = "<head><title>Caf&eacute;&#8212;1</title></head><p>it&#8217;s &lt;b&gt; &#60;i&#62;</p>"
    text = spark.createDataFrame([(page,)], "h string").select(page_text(F.col("h")), page_title(F.col("h"))).first()
    assert tuple(text) == ("it’s <b> <i>", "Café—1")


def test_both_warc_versions_are_read(spark, tmp_path):
    from holdfast.llm.op2_warc_derivatives import derive, read_responses

    def record(version, kind, name, block, length=None):
        return f"WARC/{version}\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:{name}>\r\nContent-Length: {length or len(block)}\r\n\r\n{block}\r\n\r\n"

    page = "HTTP/1.1 200 OK\r\nServer: x\r\n\r\n<p>hello</p>"
    for version in ("1.0", "1.1"):
        path = tmp_path / version
        path.mkdir()
        (path / "a.warc").write_bytes("".join([record(version, "warcinfo", "i", "x: y\r\n"), record(version, "response", "a", page), record(version, "response", "b", page)]).encode())
        got = read_responses(spark, str(path))
        assert sorted((r["record_id"], r["body"], r["complete"]) for r in got.collect()) == [(f"<urn:{x}>", "<p>hello</p>", True) for x in "ab"]
        assert derive(got).count() == 4
    (path / "b.warc").write_bytes(record("1.0", "response", "c", page + "\r\n\r\nWARC/1.0\r\nx").encode())
    with pytest.raises(Exception, match="incomplete response"):
        derive(read_responses(spark, str(path))).collect()
    (path / "b.warc").write_bytes(record("0.18", "response", "c", page).encode())
    with pytest.raises(Exception, match="no WARC 1.0 or 1.1 record"):
        read_responses(spark, str(path)).collect()
