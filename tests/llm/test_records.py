"""WARC archives, HTML text, toxicity and segmentation."""

import gzip
import itertools
import random
from html.parser import HTMLParser

import numpy as np
import pytest

from rampfield.llm import sentencepiece_nbest as sp
from pyspark.sql import functions as F

from rampfield.llm import toxicity as tox
from rampfield.llm import warc
from rampfield.llm.html_text import html_to_text, visible_text


@pytest.mark.parametrize("chunk,segment", [(7, 40), (8192, 65536), (1, 300)])
def test_archives_round_trip(spark, tmp_path, chunk, segment):
    rng = random.Random(4)
    pages = [(k, f"http://x/{k}\r\nEvil: 1", "".join(rng.choice("aé日\r\n<") for _ in range(rng.randrange(400)))) for k in range(30)]
    pages += [(100, None, None), (101, "u", ""), (102, "u", "short"), (103, "u", "short"), (None, "u", "n" * 150), (None, "v", "m" * 150)]
    pages += [(104, "u", "WARC/1.1\r\n\r\n\r\n" * 30), (106, "u", "s" * 200), (105, "u", "s" * 200), (107, "u", "s" * 200), (105, "u", "s" * 200)]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string").repartition(3)
    warc.write_archives(df, f"{tmp_path}/w", chunk=chunk, segment=segment, pack=2000)
    logical = warc.read_archives(spark, f"{tmp_path}/w")
    assert logical.filter("error is not null").count() == 0
    whole = {(r.page, bytes(r.payload).decode()) for r in logical.filter("type = 'response'").collect()}
    assert whole == {(None if p is None else str(p), h or "") for p, _, h in pages if p not in (106, 107)}
    got = {(r.page_id, r.record_type, r.refers_to, r.payload_bytes, r.error) for r in warc.page_digests(logical).collect()}
    assert (106, "revisit", 105, 200, None) in got and (107, "revisit", 105, 200, None) in got
    assert (105, "response", None, 200, None) in got and (103, "response", None, 5, None) in got
    for f in (tmp_path / "w").glob("part*"):
        assert all(x["warc-type"] for x, _ in warc.records(f.read_bytes()))


def test_broken_segments_and_chunks_are_reported(spark, tmp_path):
    body = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n" + warc.chunked(b"payload" * 20, 9)
    fields = {"WARC-Type": "response", "WARC-Record-ID": "<a>", "WARC-Date": "d", "Page-ID": "1"}
    parts = warc.segments(fields, body, 50)
    bad = warc.segments({**fields, "WARC-Record-ID": "<b>"}, body[:-9], 50)
    short = warc.segments({**fields, "WARC-Record-ID": "<c>"}, body, 50)
    data = warc.END.join([*parts[::-1], *bad, *short[:1], *short[2:]]) + warc.END
    (tmp_path / "x.warc.gz").write_bytes(gzip.compress(data))
    got = {r.id: r for r in warc.read_archives(spark, str(tmp_path)).collect()}
    assert bytes(got["<a>"].payload) == b"payload" * 20 and got["<a>"].n_segments == len(parts)
    assert got["<b>"].error and got["<b>"].payload is None and got["<c>"].error == "segments missing or doubled"
    for broken in (b"5\r\nabc", b"zz\r\n", b"3\r\nabc\r\n", b"3\r\nabcXX0\r\n\r\n", b""):
        with pytest.raises(ValueError):
            warc.unchunked(broken)
    assert warc.unchunked(b"3;x=1\r\nabc\r\n0\r\nTrailer: 1\r\n\r\n") == b"abc"


def test_ordinary_pages_are_segmented(spark, tmp_path):
    pages = [(1, "u", "a" * 500), (2, "v", "bé" * 900), (3, "w", "c" * 14_000)]
    warc.write_archives(spark.createDataFrame(pages, "page_id bigint, url string, html string"), f"{tmp_path}/w")
    numbers = [r.segment for r in warc.read_records(spark, f"{tmp_path}/w").filter("type = 'continuation'").collect()]
    assert numbers and min(numbers) == 2
    got = {r.page: (r.n_segments, bytes(r.payload).decode(), r.error) for r in warc.read_archives(spark, f"{tmp_path}/w").collect()}
    assert got == {"1": (1, pages[0][2], None), "2": (2, pages[1][2], None), "3": (7, pages[2][2], None)}


def test_no_pages(spark, tmp_path):
    empty = spark.createDataFrame([], "page_id bigint, url string, html string")
    warc.write_archives(empty, f"{tmp_path}/w")
    assert warc.page_digests(warc.read_archives(spark, f"{tmp_path}/w")).count() == 0


@pytest.mark.parametrize("page,text", [
    ("", ""), ("<title>t</title>", ""), ("<p>a<p>b", "a\n\nb"), ("a<br>b<br></p>", "a\nb"), ("x &lt;y&gt; &amp; z &eacute;", "x <y> & z é"),
    ("<ul><li>a<li>b<ul><li>c</ul></ul>d", "- a\n- b\n  - c\n\nd"), ("<ol start=9><li>a<li value=20>b<li>c</ol>", "9. a\n20. b\n21. c"),
    ("<table><tr><td>a<td>b<tr><td>long<td>d</table>", "a     b\nlong  d"), ("<table>f<tr><td>x</table>", "f\n\nx"),
    ("<table><tr><td colspan=2>h<tr><td rowspan=2>r<td>1<tr><td>2</table>", "h\nr  1\n   2"),
    ("<pre>a  b\n  c</pre>", "a  b\n  c"), ("a<script>x</script><style>y</style><!-- z -->b", "ab"), ("<div hidden>a</div>b", "b"),
    ("<div style='display: none'>a<p>x</div>b", "b"), ("<div style='visibility:hidden'>a<i style='visibility:visible'>x</i></div>", "x"),
    ("<style>.n{display:none}</style><p class='m n'>a<p class=m>b", "b"), ("<details><summary>s</summary>a</details>", "s"),
    ("<dialog>a</dialog><dialog open>b</dialog>", "b"), ("5 < 6 <7 & <b>x", "5 < 6 <7 & x"), ("<a href='>'>x</a <p>y", "xy"),
    ("<h1>a<h2>b</h2>c", "a\n\nb\n\nc"), ("<dl><dt>t<dd>d<dt>u</dl>", "t\n  d\nu"), ("<tr><td>no table", "no table"), ("<p hidden>a", ""),
])
def test_html_layout(page, text):
    assert html_to_text(page) == text


@pytest.mark.parametrize("page,text", [
    ("<table><form><tr><td>a<td>b</form></table>c", "a  b\n\nc"), ("<table><tr><form><td>a<td>b</table>", "a  b"),
    ("<table><tr><td>a</td><noscript>n</noscript><td>b</table>", "n\n\na  b"), ("<table><colgroup>t<col><tr><td>a</table>", "t\n\na"),
    ("<style>.tab{display:none} .tab.active{display:block}</style><p class=tab>x<p class='tab active'>a", "a"),
    ("<style>.tab.active{display:block} .tab{display:none}</style><p class='tab active'>a", "a"),
    ("<style>.n{display:none}</style><p class=n style='display:block'>a", "a"), ("<p hidden style='display:block'>a", "a"),
    ("<style>.n{display:none !important}</style><p class=n style='display:block'>a<p>b", "b"),
    ("<style>@media print{.n{display:none}} .m{display:none}</style><p class=n>a<p class=m>x", "a"),
    ("<style>@media screen{.n{display:none}}</style><p class=n>x<p>a", "a"), ("<style media=print>p{display:none}</style><p>a", "a"),
    ("<style>@import 'x'; @media (max-width: 600px){.n{display:none}.o{color:red}} .m{display:none}</style><p class=n>a<p class=m>x", "a"),
    ("<style>@font-face{font-family:x} @media not print{.n{display:none}}</style><p class=n>x<p>a", "a"),
])
def test_html_shown_text_is_kept(page, text):
    assert html_to_text(page) == text


def test_html_text_keeps_all_words(spark):
    class Words(HTMLParser):
        def __init__(self):
            super().__init__()
            self.out, self.skip = [], 0

        def handle_starttag(self, tag, attrs):
            self.skip += tag in ("script", "style", "title")

        def handle_endtag(self, tag):
            self.skip -= tag in ("script", "style", "title")

        def handle_data(self, data):
            if not self.skip:
                self.out += data.split()

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    html = {r.page_id: r.html for r in pages.collect()}
    for r in visible_text(pages).collect():
        naive = Words()
        naive.feed(html[r.id])
        ours = [w for w in r.text.split() if w != "-"]
        assert sorted(ours) == sorted(w for w in " ".join(naive.out).split() if w != "-") or "hidden" in html[r.id] or "display" in html[r.id]
    odd = spark.createDataFrame([(1, None), (None, ""), (2, "<p>" * 3000 + "x")], "page_id bigint, html string")
    assert {(r.id, r.text) for r in visible_text(odd).collect()} == {(1, None), (None, ""), (2, "x")}


def test_grammar_tells_modes():
    read = tox.Reader(tox.Lexicon({"idiot": 2.0}))
    mode = lambda t: [tox.MODES[k % 4] + "/" + "it"[k // 4] for k in np.flatnonzero(read.clause(t))]
    assert mode("an idiot") == ["plain/i"] and mode("you idiotic fool") == ["aimed/i"]
    assert mode("he is not an idiot") == ["negated/i"] and mode("she said idiot") == ["reported/i"]
    assert mode('the "idiot" word') == ["reported/i"] and mode("i will kill you") == ["aimed/t"] and mode("you i kill") == ["aimed/t"]
    assert mode("i will kill time") == ["plain/t"] and mode("i killed him and stabbed her") == ["aimed/t"] and mode("killjoy beaters") == ["plain/t"]
    assert mode("idiot i do not kill you") == ["aimed/i", "negated/t"]
    assert mode("not a b c d idiot") == ["plain/i"] and read.features("nonidiot").sum() == 0
    assert read.features("").shape == (10,) and read.features("idiot. idiot, idiot")[9] == pytest.approx(np.log(4))


def test_composed_machine_equals_rules_applied_word_by_word():
    """Every hit of random clauses by its rules: reported before negated before aimed before plain."""
    rng, reader = random.Random(6), tox.Reader(tox.Lexicon({"idiot": 1.5}))
    spelled = {tox.OTHER: "word", tox.INSULT: "idiot", tox.THREAT: "kill", tox.TARGET: "you", tox.NEGATION: "not", tox.REPORT: "said", tox.QUOTE: '"'}
    for _ in range(3000):
        clause = rng.choices(range(7), weights=[6, 3, 2, 1, 1, 0.5, 0.7], k=rng.randint(0, 14))
        want = np.zeros(8)
        for i, s in enumerate(clause):
            if s not in (tox.INSULT, tox.THREAT):
                continue
            before = clause[:i]
            if tox.REPORT in before or before.count(tox.QUOTE) % 2:
                mode = 3
            elif tox.NEGATION in clause[max(0, i - tox.REACH) : i]:
                mode = 2
            else:
                mode = int(tox.TARGET in clause)
            row = s == tox.INSULT and i and clause[i - 1] == tox.INSULT
            want[4 * (s == tox.THREAT) + mode] += (1.5 if s == tox.INSULT else tox.THREAT_WEIGHT) * (tox.IN_A_ROW if row else 1)
        assert np.allclose(reader.clause(" ".join(spelled[s] for s in clause)), want), clause


def test_toxicity_of_direct_threats_odd_columns_and_ties(spark, table):
    rng = random.Random(4)
    plain = lambda: " ".join(rng.choice(["river", "stone", "walks", "green", "quiet"]) for _ in range(30))
    docs = [(k, plain() + (" zorgle" if k % 4 == 0 else "")) for k in range(200)]
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(200)], "doc_id bigint, toxic int")
    model = tox.train(table(docs), labels)
    more = [(900, "i will kill you"), (901, "kill time by the river"), (902, "he said he will kill you"), (903, plain()), (903, docs[1][1])]
    odd = table(more).withColumn("my col", F.lit(1)).withColumn("a`b", F.lit("x")).withColumn("score", F.lit(5))
    got = {(r.id, r.row["text"]): r.score for r in tox.toxicity(odd, model).collect()}
    assert len(got) == 5 and got[900, more[0][1]] > got[901, more[1][1]] and got[900, more[0][1]] > got[902, more[2][1]]
    assert {r.row["my col"] for r in tox.toxicity(odd, model).collect()} == {1}
    # stems that are equally sure: the longer one, then the first by name
    same = [(k, "abcdef" if k % 2 else "plain words") for k in range(60)]
    known = spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id bigint, toxic int")
    assert list(tox.train(table(same), known).lexicon.insults) == ["abcdef"]


def test_toxicity_learns_and_separates(spark, table):
    rng = random.Random(2)
    plain = lambda n: " ".join(f"{rng.choice('bcdfg')}{rng.choice('aeiou')}{rng.choice('lmnr')}{rng.randrange(50)}q" for _ in range(n))
    docs = [(k, plain(40) + (f" zorg{rng.choice(['le', 'ler', 'x'])} {plain(3)}" if k % 4 == 0 else "")) for k in range(400)]
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(200)] + [(None, 1), (3, None), (5, 0)], "doc_id bigint, toxic int")
    model = tox.train(table(docs), labels)
    got = {r.id: r.score for r in tox.toxicity(table(docs + [(1000, None), (1001, "")]), model).collect()}
    assert all((got[k] >= 0.5) == (k % 4 == 0) for k in range(400))
    assert got[1000] == got[1001] < 0.5
    assert tox.train(table(docs), labels.limit(0)) == tox.UNTRAINED
    assert tox.toxicity(table(docs).limit(0), model).count() == 0


@pytest.fixture(scope="module")
def words():
    with open(sp.MODEL, "rb") as f:
        return sp.load_vocabulary(f.read())


def every_segmentation(text, words):
    def go(at):
        if at == len(text):
            yield 0.0, b""
            return
        ends = [b for b in range(at + 1, len(text) + 1) if text[at:b] in words.pieces]
        options = [(b, *words.pieces[text[at:b]]) for b in ends]
        if at + 1 not in ends:
            options.append((at + 1, *words.spelled(text[at])))
        for b, ids, s in options:
            for rest, more in go(b):
                yield s + rest, ids + more

    return sorted(go(0), key=lambda x: -x[0])


@pytest.mark.parametrize("text", ["Hello", "the cat", "a  b", "日本x", "é▁z", "ab\ncd", " x ", "in.er,", "\U0001F600!", "\x00a"])
def test_n_best_is_every_segmentation_in_order(words, text):
    want = every_segmentation(" " + text, words)
    got = sp.Encoder(words, 50).n_best(text)
    assert [s for s, _ in got] == pytest.approx([s for s, _ in want[:50]])
    assert len({i for _, i in got}) == len(got) and {i for _, i in got} <= {i for _, i in want}
    assert all(sp.Decoder(words).text(np.frombuffer(i, "<i4").tolist()) == text for _, i in got)


def test_best_sums_are_all_sums_in_order():
    rng = random.Random(8)
    for n in (1, 2, 5, 40):
        lists = [sorted(((-rng.random(), bytes([k])) for k in range(rng.randrange(1, 4))), reverse=True) for _ in range(5)]
        want = sorted((sum(x[0] for x in c) for c in itertools.product(*lists)), reverse=True)[:n]
        losses = np.array([x[0][0] - x[1][0] if len(x) > 1 else np.inf for x in lists])
        got = sp.best_sums(sum(x[0][0] for x in lists), losses, lists.__getitem__, n)
        assert [s for s, _ in got] == pytest.approx(want) and len({tuple(sorted(c.items())) for _, c in got}) == len(got)
        assert [s for s, _ in got] == pytest.approx([sum(x[c.get(k, 0)][0] for k, x in enumerate(lists)) for _, c in got])


def test_encode_and_decode_tables(table):
    from pyspark.sql import functions as F

    docs = [(1, "the cat"), (2, None), (3, ""), (None, "x" * 3000), (5, "▁ ▁\n\t é"), (5, "▁ ▁\n\t é")]
    found = sp.encode(table(docs), n=2)
    rows = sorted((r.id or 0, len(r.segmentations)) for r in found.collect())
    # null and empty texts have one segmentation, all the others here have more than two
    assert rows == [(0, 2), (1, 2), (2, 1), (3, 1), (5, 2), (5, 2)]
    back = sp.decode(found.select("id", F.col("segmentations")[0]["ids"].alias("ids")), "id", "ids")
    assert sorted((r.id or 0, r.text) for r in back.collect()) == sorted((i or 0, t or "") for i, t in docs)
    assert all(r.restored for r in sp.encoded_digests(table(docs)).collect())
    assert sp.encode(table(docs).limit(0)).count() == 0
