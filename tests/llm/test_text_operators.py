import math
import random
import re

import pytest
import sentencepiece
from pyspark.sql import functions as F

from waymark.llm import chat_format, mincut_html, mixing, piece_bpe, quality_classifier, quality_rules, spot_signatures
from waymark.llm.queries import TOKENIZERS

from .brute import words

MODEL = f"{TOKENIZERS}/piece_bpe_32k.model"
SF = "/root/testdata/sf0.001"


# --- piece BPE


def odd_texts():
    rng = random.Random(3)
    chars = list(" ▁\n\taab=-_#eé日𝒳\x00th ing     ")
    texts = ["".join(rng.choices(chars, k=rng.randint(0, 60))) for _ in range(3000)]
    return texts + ["a" * 5000, "ab" * 3000, " " * 999, "=" * 3333 + "x", "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=5000)), "<s></s><unk><0x0A>", "", " ", "\n"]


def test_ids_equal_the_library(spark):
    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()] + odd_texts()
    with open(MODEL, "rb") as f:
        bpe = piece_bpe.PieceBpe(f.read())
    assert bpe.encode(texts) == lib.encode(texts, add_eos=True)


def test_long_segments_equal_the_library_in_time():
    import time

    rng = random.Random(5)
    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    with open(MODEL, "rb") as f:
        bpe = piece_bpe.PieceBpe(f.read())
    letters = "abcdefghijklmnopqrstuvwxyz"
    texts = ["".join(rng.choices(x, k=n)) for x in (letters, letters.upper() + letters + "0123456789+/", "ab=-_#eé日𝒳th", "a", " a") for n in (511, 512, 513, 30_000)]
    texts += ["".join(rng.choices(letters, k=1_000_000)), "".join(chr(rng.randint(0x4E00, 0x9FFF)) for _ in range(1_000_000))]
    began = time.time()
    assert bpe.encode(texts) == lib.encode(texts, add_eos=True) and time.time() - began < 60


def test_forgetting_changes_nothing(monkeypatch):
    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    monkeypatch.setattr(piece_bpe, "REMEMBERED", 5)
    with open(MODEL, "rb") as f:
        bpe = piece_bpe.PieceBpe(f.read())
    for t in odd_texts()[:200]:
        assert bpe.encode([t, t]) == lib.encode([t, t], add_eos=True)


def test_encode_decode(spark):
    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    df = spark.createDataFrame([(1, "a  b\n c", 1), (2, None, 1), (2, None, 1), (None, "é", 1)], "doc_id long, text string, ids int")
    got = {r["doc_id"]: (r["ids"], r["decoded"]) for r in piece_bpe.encode_decode(df, MODEL).collect()}
    assert got[2] == ([lib.eos_id()], "") and got[1] == (lib.encode("a  b\n c", add_eos=True), "a  b\n c")
    assert piece_bpe.encode_decode(df.limit(0), MODEL).count() == 0


# --- chat format


def test_any_turns_come_back(spark):
    rng = random.Random(4)
    bits = ["###", "### ", ": ", " </turn>\n", "!", "\\", "\\s", "\\\\", "/", "a", "\n", " ", "\x00", "é", "### user: hi </turn>\n", ":", "#", "$1", "\\E", ""]
    rows = [(c, t, "".join(rng.choices(bits, k=rng.randint(0, 3))) if rng.random() < 0.3 else rng.choice(["user", "assistant"]), "".join(rng.choices(bits, k=rng.randint(0, 8)))) for c in range(150) for t in range(rng.randint(1, 5))]
    rows += [(900, None, None, None), (901, 1, "user", None), (None, 1, "assistant", "x"), (902, 1, "a", "b"), (902, 1, "a", "b")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, parsed string")
    got = chat_format.format_chats(df).collect()
    want = {}
    for c, t, r, x in rows:
        want.setdefault(c, []).append((t if t is not None else -1, r or "", x or ""))
    assert len(got) == len(want)
    for r in got:
        assert r["identical"]
        assert [(p["role"], p["text"]) for p in r["parsed"]] == [x[1:] for x in sorted(want[r["conv_id"]])]
    assert chat_format.format_chats(df.limit(0)).count() == 0


def test_sql_of_the_format_escapes_what_the_operator_does(spark, tmp_path):
    import duckdb

    from waymark.llm import queries

    bits = ["</turn>\n", " </turn>\n", ": ", "!", "\\", "a", " ", "#", "/"]
    rows = [(c, t, r, x + y) for c, (x, y) in enumerate((x, y) for x in bits for y in bits) for t, r in ((0, "user" if c % 5 else x), (1, "assistant"))]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = queries.op4_chat_format(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    want = con.execute(queries.OP4_SQL)
    names = [d[0] for d in want.description]
    assert sorted(tuple(r) for r in got.select(*names).collect()) == sorted(want.fetchall())


def test_plain_text_is_not_escaped(spark):
    df = spark.createDataFrame([(1, 0, "user", "why? \\ 1/2: #x!"), (1, 1, "assistant", "so")], "conv_id long, turn long, role string, text string")
    row = chat_format.format_chats(df).withColumn("loss", chat_format.loss_spans(F.col("parsed"))).first()
    assert row["formatted"] == "### user: why? \\ 1/2: #x! </turn>\n### assistant: so </turn>\n" and row["loss"] == ["so"]


# --- HTML


def test_article_of_a_page():
    page = """<html><head><title>x</title><script>var a="<p>no</p>";</script></head><body><header><h1>Site</h1><nav><a href=a>Home</a></nav></header>
<div class="cookie-notice">We use cookies. <button>OK</button></div><div id="main"><div class="sidebar"><h3>Related</h3><ul><li><a href=x>Foo</a></li></ul></div>
<div class="article-body"><h2>Title here</h2><p>This is a first paragraph &amp; it has some <b>text</b> in it,
   enough to be article.</p><p>Short.</p><ul><li>one item</li><li>two</li></ul><blockquote>A quote that goes on.</blockquote><div class="ad">Buy now!</div>
<p>Last paragraph &nbsp; of this text, which is fine.</p><form><label>Email</label><input><button>Subscribe</button></form></div>
<section class="comments"><h3>Comments</h3><div class="comment"><p>I think this is a great article and I would like to say so at length, really.</p></div></section></div>
<aside><p>Popular stories that are long enough to appear like text paragraphs, surely so.</p></aside><footer><p>&copy; 2020 all rights</p></footer></body></html>"""
    assert mincut_html.extract(page).split("\n\n") == ["Title here", "This is a first paragraph & it has some text in it, enough to be article.", "Short.", "one item", "two", "A quote that goes on.", "Last paragraph of this text, which is fine."]


LONG = "This paragraph has enough words to be taken for a part of an article by any measure."


@pytest.mark.parametrize(
    "body",
    [
        "<div class='wrapper has-sidebar'><main>{}</main><div id=sidebar><p>" + LONG + "</p></div></div>",
        "<div id=breadcrumbs><a href=/>Home</a> &gt; <a href=/x>X</a></div><div class='post hentry'>{}</div><ol class='comment-list'><li><article class=comment><p>" + LONG + "</p></article></li></ol>",
        "<div role=alert><p>" + LONG + "</p></div><div class='post-content'>{}<aside class=related><p>" + LONG + "</p></aside></div>",
        "<ul><li><a href=1>One</a><li><a href=2>Two</a></ul><div>{}</div><div>&copy; 2024 Some site</div>",
        "<article><header class='entry-header'></header>{}<footer><p>By someone</p></footer></article><div class=newsletterSignup><p>" + LONG + "</p></div>",
        "<main>{}<p class='advertisement'>" + LONG + "</p></main><div style='display: none'>" + LONG + "</div><noscript><p>" + LONG + "</p></noscript><template><p>no</p></template>",
        "<form><p>" + LONG + "</p></form><section id='content'>{}</section><section class='user-comments'><h2>2 comments</h2><p>" + LONG + "</p></section>",
    ],
)
def test_furniture_goes(body):
    inner = f"<h1>A title</h1><p>{LONG}<p>Short one.</p><div>{LONG} <a href=x>With</a> a <i>link</i>.<br>And more.</div><ul><li>An item<li>Another</ul><pre>a  b</pre>"
    got = mincut_html.extract("<html><head><title>t</title></head><body>" + body.replace("{}", inner) + "</body></html>").split("\n\n")
    assert got == ["A title", LONG, "Short one.", LONG + " With a link. And more.", "An item", "Another", "a b"]


def test_time_grows_with_the_length():
    import time

    page = "<article>" + "<p>some <b>bold</b> text</p>" * 2000 + "<p>" + "<i>x</i> " * 30000 + "</p></article>"
    began = time.time()
    assert len(mincut_html.extract(page)) > 40000 and time.time() - began < 10


@pytest.mark.parametrize("page", [None, "", "   ", "<", "<p", "<!-- x", "</p></div>", "<script>a", "<div>" * 3000 + "x", "<p>a" * 2000, "&#0;&#x110000;&bogus;", "<p title='a>b'>"])
def test_broken_pages_do_not_crash(page):
    assert isinstance(mincut_html.extract(page), str)


@pytest.mark.parametrize("raw", ["<script>var a = 1;</script>", "<STYLE>p {}</STYLE>", "<noscript>no</NoScript>", "<textarea>no</textarea>"])
def test_raw_elements_end_where_they_do_behind_letters_of_two_cases(raw):
    page = f"<html><head><title>İstanbul İİİ</title></head><body><article><p>{LONG}</p>{raw}<p>İ {LONG}</p>{raw}<p>{LONG}</p></article></body></html>"
    assert mincut_html.extract(page).split("\n\n") == [LONG, f"İ {LONG}", LONG]


@pytest.mark.parametrize("before, after", [("<div>", "</div>"), ("<div>", ""), ("<b>", ""), ("<span><div>", "</div></span>"), ("<ul><li>", "</ul>")])
@pytest.mark.parametrize("n", [1, 1000])
def test_depth_changes_no_label(before, after, n):
    furniture = f"<aside>{before * n}<p>{LONG}</p>{after * n}</aside>"
    page = f"<div id=main>{furniture}<article><p>{LONG}</p></article><nav><p>{LONG}</p></nav><p>{LONG} End.</p></div>{before * n}<div><p>{LONG} Deep.</p><form><p>{LONG}</p></form></div><footer><p>{LONG}</p></footer>"
    assert mincut_html.extract(page).split("\n\n") == [LONG, f"{LONG} End.", f"{LONG} Deep."]


@pytest.mark.parametrize("unit", ["<div></section>", "<b></i>", "<b>x<p>y</p>", "<li><b>", "<div><td>x", "<p><span>x</b>"])
def test_time_grows_with_the_depth(unit):
    import time

    began = time.time()
    assert len(mincut_html.blocks(unit * 30000)) <= 60000 and time.time() - began < 5


ARTICLE = ["A title", LONG, "Short one.", f"{LONG} End."]
HOLDS = f"<h1>A title</h1><p>{LONG}</p><p>Short one.</p><p>{LONG} End.</p>"


@pytest.mark.parametrize("names", ["post comments-open", "post hentry tag-notice", "post category-popular", "story legal", "post", "entry status-publish no-sidebar", "trending", "legal"])
def test_names_of_states_and_subjects_drop_no_article(names):
    page = f"<body class='{names}'><ul><li><a href=x>Home</a></li></ul><div class='{names}'>{HOLDS}</div><div class='post-comments'><p>{LONG}</p></div><div class=footer><p>{LONG}</p></div></body>"
    assert mincut_html.extract(page).split("\n\n") == ARTICLE


@pytest.mark.parametrize("tag", ["<p title=it's>", "<p title='it\"s'>", "<p it's>", '<p title="a>', "<p title = a'b/ c>", "<p a=b/>", "<p a='x>y'>", "<p =>"])
def test_quotes_in_tags_lose_no_text(tag):
    assert mincut_html.extract(f"<article>{tag}{LONG}</p><p>It's {LONG}</p></article>").split("\n\n") == [LONG, f"It's {LONG}"]


def test_signs_that_begin_no_tag_are_text():
    assert mincut_html.extract(f"<article><p>1 < 2, 3 <é 4 <3 {LONG}</p></article>") == f"1 < 2, 3 <é 4 <3 {LONG}"


@pytest.mark.parametrize("inner", [f"<main>{HOLDS}</main>", f"<div>{HOLDS}</div>"])
def test_a_form_around_the_page_drops_no_article(inner):
    page = f"<form id=aspnetForm><div class=menu><a href=x>x</a></div>{inner}<footer><p>{LONG}</p></footer></form>"
    assert mincut_html.extract(page).split("\n\n") == ARTICLE


@pytest.mark.parametrize("unit", ["<a ", "<p title=it's ", "<p title=\"x' ", "<!", "<!--x", "</", "<a x='", "<a x=\"'", "<?x", "<", "<a b= ", "<x>"])
def test_time_grows_with_broken_tags(unit):
    import time

    began = time.time()
    mincut_html.extract(unit * 60000)
    assert time.time() - began < 5


#: Pages without names, where a block's own cues are wrong: (page, article, blocks that the cut labels against them).
CUT_DECIDES = [
    (f"<div><p>{LONG}</p><p><a href=x>See the other part</a></p><p>{LONG}</p></div>", [LONG, "See the other part", LONG], 1),
    (f"<ul><li><a href=1>Home</a></li><li><a href=2>World</a></li><li>{LONG}</li><li><a href=3>Sport</a></li><li><a href=4>Mail</a></li></ul><div><p>{LONG} 2</p><p>{LONG}</p></div>", [f"{LONG} 2", LONG], 1),
    (f"<div class='story legal'><p>{LONG}</p><p>Short one</p></div>", [LONG, "Short one"], 1),
    (f"<div><p>{LONG}</p><p><a href=x>One link</a></p><p>{LONG}</p><p><a href=x>And one more</a></p><p>{LONG}</p></div>", [LONG, "One link", LONG, "And one more", LONG], 2),
]


@pytest.mark.parametrize("page, article, turned", CUT_DECIDES)
def test_the_cut_is_right_where_blocks_alone_are_wrong(page, article, turned):
    parts = mincut_html.blocks(page)
    inside = mincut_html.labels(parts)
    assert mincut_html.extract(page).split("\n\n") == article
    assert sum(x != (b.evidence() > 0) for b, x in zip(parts, inside)) == turned


def test_formulas_and_fallbacks_are_text():
    formula = "<math><semantics><mrow><mi>x</mi><mo>=</mo><mn>2</mn></mrow><annotation encoding='application/x-tex'>x = 2</annotation><annotation-xml><ci>x</ci></annotation-xml></semantics></math>"
    media = "".join(f"<{n}><p>{LONG} {n}</p></{n}>" for n in ("object", "audio", "video", "canvas"))
    page = f"<article><p>Here {formula} holds. {LONG}</p>{media}</article><nav><object><p>{LONG}</p></object></nav>"
    assert mincut_html.extract(page).split("\n\n") == [f"Here x=2 holds. {LONG}", *(f"{LONG} {n}" for n in ("object", "audio", "video", "canvas"))]


def test_pages_of_the_fixture(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r["page_id"]: r["text"] for r in mincut_html.extract_pages(pages).collect()}
    import html

    for p in pages.collect():
        inner = re.search(r"<article>(.*)</article>", p["html"], re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", x).replace("\n", " ")).split()) for x in re.split(r"</?(?:p|h1)>", inner)]
        assert got[p["page_id"]] == "\n\n".join(x for x in parts if x)


def test_cut_is_minimal():
    rng = random.Random(5)
    for _ in range(60):
        n = rng.randint(1, 7)
        terminal = [(rng.random() * 4, rng.random() * 4) for _ in range(n)]
        edges = [(a, b, rng.random() * 2) for a in range(n) for b in range(a) if rng.random() < 0.5]
        cut = mincut_html.Cut(n)
        for i, (s, t) in enumerate(terminal):
            cut.edge(n, i, s, 0.0)
            cut.edge(i, n + 1, t, 0.0)
        for a, b, c in edges:
            cut.edge(a, b, c, c)
        cost = lambda side: sum(t if x else s for x, (s, t) in zip(side, terminal)) + sum(c for a, b, c in edges if side[a] != side[b])
        best = min(cost([k >> i & 1 for i in range(n)]) for k in range(1 << n))
        assert cost(cut.source_side()) == pytest.approx(best)


# --- spot signatures


def test_edits_and_neighbours(spark, monkeypatch):
    monkeypatch.setattr(spot_signatures, "BUCKET_ROWS", 3)
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()][:80]
    rows = docs + [(10**6, None), (10**7, ""), (10**8, "日本 語"), (10**8 + 1, "the " * 20000)]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, sigs int")
    got = {r["doc_id"]: r for r in spot_signatures.edits(df).withColumn("fp", spot_signatures.fingerprint(F.col("sigs"))).withColumn("near", spot_signatures.likeness(F.col("sigs"), F.col("next_sigs"))).collect()}
    rows.sort()
    assert len(got) == len(rows)
    for k, (i, t) in enumerate(rows):
        t, after, quarter = t or "", rows[(k + 1) % len(rows)], len(t or "") // 4
        assert got[i]["n_chars"] == len(t)
        assert got[i]["edited"] == t[: len(t) - quarter] + (after[1] or "")[:quarter]
        a, b = set(got[i]["sigs"]), set(got[after[0]]["sigs"])
        assert set(got[i]["next_sigs"]) == b
        assert got[i]["near"] == pytest.approx(len(a & b) / len(a | b) if a | b else 1.0)
        assert got[i]["fp"] == ",".join(map(str, sorted(a)))


def test_a_far_id_spoils_few_buckets(spark):
    rows = spark.range(200_000).selectExpr("id AS doc_id", "'x' AS text").union(spark.createDataFrame([(1 << 60, "far")], "doc_id long, text string"))
    both, _ = spot_signatures.in_order(rows, "text")
    assert both.groupBy("_bucket").count().agg(F.max("count")).first()[0] <= 4000


def test_neighbours_of_few_rows(spark):
    df = spark.createDataFrame([(3, "the cat sat"), (None, "of a dog"), (3, "the cat sat")], "doc_id long, text string")
    assert spot_signatures.edits(df).count() == 3
    assert spot_signatures.edits(df.limit(0)).count() == 0
    assert spot_signatures.edits(df.limit(1)).count() == 1


def test_chains_follow_anchors(spark):
    texts = ["x1 The big cat sat here of, the house!", "one two three four", "of the", "... ", None, "the " * 9000 + "é1 " * 9000]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    got = {r["k"]: r["s"] for r in rows.select("k", spot_signatures.signatures(F.col("t")).alias("s")).collect()}

    def hashes(*chains):
        return sorted(r["h"] for r in spark.createDataFrame([(c,) for c in chains], "c string").select(F.hash("c").alias("h")).collect())

    assert got[0] == hashes("x1", "big  cat  sat", "here", "house")
    assert got[1] == hashes("one  two  three", "four") and got[2] == hashes("of  the")
    assert got[3] == got[4] == [] and got[5] == hashes("é1  é1  é1")


def test_similar_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    sets = {r["doc_id"]: frozenset(r["s"]) for r in docs.select("doc_id", spot_signatures.signatures(F.col("text")).alias("s")).collect()}
    least = {}
    for i in sorted(sets):
        least.setdefault(sets[i], i)
    ids = sorted(i for i in least.values() if sets[i])
    want = {(a, b) for a in ids for b in ids if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    assert {(r["a"], r["b"]) for r in spot_signatures.similar(docs).collect()} == want


# --- quality rules


def test_rules_equal_brute_force(spark):
    rng = random.Random(6)
    menu = "Home 12 About"
    rows = []
    for i in range(60):
        body = [" ".join(rng.choice("abcdefghij#|") for _ in range(rng.randint(0, 30))) for _ in range(rng.randint(0, 5))]
        rows.append((i, rng.choice(["h", None]), "\n".join(body + [f"  home  {i}\tabout"] * rng.randint(0, 3))))
    rows += [(100, "h", None), (101, "h", ""), (102, "tiny", "a b " * 500), (102, "tiny", "a b " * 500)]
    df = spark.createDataFrame([(i, s, t, 5) for i, s, t in rows], "doc_id long, source string, text string, `row` int")
    got = sorted((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["kept"], r["n_line_words"]) for r in quality_rules.quality_rules(df).collect())
    norm = lambda x: " ".join(re.sub("[0-9]", "0", x.lower()).split())
    having, hosts = {}, {}
    for _, s, t in rows:
        hosts.setdefault(s, set()).add(t or "")
        for x in (t or "").split("\n"):
            if norm(x):
                having.setdefault((s, norm(x)), set()).add(t)
    want = []
    for i, s, t in rows:
        t, w = t or "", words(t)
        lines = [x for x in t.split("\n") if words(x)]
        grams = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        often = {k + j for k, g in enumerate(grams) if grams.count(g) > 1 for j in range(5)}
        gone = sum(len(words(x)) for x in lines if len(having[s, norm(x)]) > max(5, 0.05 * len(hosts[s])))
        kept = len(w) >= 10 and 100 * len(often) <= 20 * len(w) and len(w) - gone >= 0.3 * len(w)
        want.append((i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(often), kept, gone))
    assert got == sorted(want) and any(x[-1] for x in want) and menu
    assert quality_rules.quality_rules(df.limit(0)).count() == 0


# --- mixing


def test_mix(spark):
    rng = random.Random(8)
    rows = [(i, rng.choice(["a", "b", "é", None]) if i % 3 else "hot", " ".join("w" for _ in range(rng.randint(0, 40)))) for i in range(400)]
    rows += [(1000, "one", "x y z"), (1001, "nil", ""), (1002, "nil", None), (5, "hot", "a b"), (5, "hot", "a b"), (None, "a", "q w e")]
    df = spark.createDataFrame([(i, s, t, 1) for i, s, t in rows], "doc_id long, source string, text string, target int")
    mix = mixing.Mix(df, slots=64)
    taken = mix.taken().collect()
    assert len(taken) == len(rows)
    sums, size, goal = {}, {}, {}
    for r in taken:
        assert 0 <= r["taken"] <= 2 * r["size"]
        sums[r["source"]] = sums.get(r["source"], 0) + r["taken"]
        size[r["source"]], goal[r["source"]] = r["source_size"], r["target"]
    assert sum(goal.values()) == pytest.approx(1.5 * sum(size.values()))
    order = sorted((s for s in size if s), key=str) + [None]
    rate = [goal[s] / (3, 1, 2)[k % 3] for k, s in enumerate(order) if goal[s] < 2 * size[s]]
    assert max(rate) == pytest.approx(min(rate))
    assert all(sums[s] == round(goal[s]) for s in size)
    slots = mix.slots.orderBy("source", "rank").collect()
    for s in size:
        own = [r for r in slots if r["source"] == s]
        assert [r["rank"] for r in own] == list(range(len(own))) and sum(r["tokens"] for r in own) == sums[s]
    held = {}
    for r in mix.stream().collect():
        held.setdefault(r["slot"], []).append(r)
    assert {k: sum(r["words"] for r in v) for k, v in held.items()} == {r["slot"]: r["tokens"] for r in slots}
    assert all(0 <= r["first_word"] and r["first_word"] + r["words"] <= r["size"] for v in held.values() for r in v)
    again = {(r["doc_id"], r["size"], r["start"]): r["taken"] for r in mixing.Mix(df.repartition(7), slots=64).taken().collect()}
    assert again == {(r["doc_id"], r["size"], r["start"]): r["taken"] for r in taken}
    out = mixing.mix_documents(df, slots=64)
    assert out.columns == df.columns
    assert sum(len(words(r["text"])) for r in out.collect()) == sum(sums.values())
    assert mixing.Mix(df.limit(0)).taken().count() == 0


def test_mixed_rows_keep_all_columns_and_come_in_slots(spark):
    names = ["size", "turns", "part", "slot", "slots", "taken", "target", "_size", "_d", "_slot", "key", "bucket"]
    rows = [(i, "ab"[i % 2], "w " * (1 + i % 7) + str(i), *(-i - k for k in range(len(names)))) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, " + ", ".join(f"`{n}` int" for n in names))
    out = mixing.mix_documents(df, slot="first slot", slots=50)
    assert out.columns == [*df.columns, "first slot"]
    got = out.collect()
    assert {tuple(r[n] for n in names) for r in got} <= {r[3:] for r in rows}
    assert all(rows[r["doc_id"]][2].split()[: len(words(r["text"]))] == words(r["text"]) for r in got)
    stream = mixing.Mix(df, slots=50).stream().groupBy("doc_id", "turn").agg(F.min("slot").alias("slot")).collect()
    assert sorted((r["doc_id"], r["first slot"]) for r in got) == sorted((r["doc_id"], r["slot"]) for r in stream)


def test_any_prefix_of_the_schedule_is_near_the_shares(spark):
    rows = [(i, "abc"[i % 3], "w " * 100) for i in range(300)]
    mix = mixing.Mix(spark.createDataFrame(rows, "doc_id long, source string, text string"), slots=1024)
    goal = {r["source"]: r["target"] for r in mix.goals.collect()}
    order = [r["source"] for r in mix.slots.orderBy("slot").collect()]
    for n in (32, 100, 500):
        for s, g in goal.items():
            assert abs(order[:n].count(s) - n * g / sum(goal.values())) <= 12


# --- quality classifier


def test_classifier_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    train = labels.where("doc_id % 3 <> 0")
    got = quality_classifier.QualityClassifier(docs, train).classify(docs)
    test = got.join(labels.where("doc_id % 3 = 0"), "doc_id").collect()
    assert sum((r["quality"] > 0) == r["kept"] for r in test) >= 0.95 * len(test)
    assert sum(r["kept"] for r in test if r["quality"]) >= 0.98 * sum(r["quality"] for r in test)


def classified(rows, quality):
    """(weights, score of each row (doc_id, text, host, path)) by loops over documents, from the fit on."""
    import numpy as np

    Q = quality_classifier

    def probability(fit, text):
        buckets, _ = Q.tokens([(text or "").encode()])
        if not len(buckets):
            return math.log(fit.prior / (1 - fit.prior))
        return fit.slope * sum(fit.weights[b] for t in buckets for b in t) / len(buckets) + fit.shift

    def counts(train):
        tally = {0: [0] * Q.ALL, 1: [0] * Q.ALL}
        for text, good in train:
            for t in Q.tokens([text.encode()])[0]:
                for b in t:
                    tally[good][b] += 1
        return [np.array(tally[k]) for k in (1, 0)]

    def scores(fit):
        odds = [probability(fit, t) for _, t, _, _ in rows]
        p = [1 / (1 + math.exp(-o)) for o in odds]
        n, world = len(rows), sum(p) / len(rows)

        def sites(*columns):
            of = {}
            for r, x in zip(rows, p):
                of.setdefault(tuple(r[c] for c in columns), []).append(x)
            return of

        hosts, paths = sites(2), sites(2, 3)
        mean = lambda x: sum(x) / len(x)

        def strength(parts, above, many):
            s2 = sum((x - mean(v)) ** 2 for v in parts.values() for x in v) / (n - len(parts))
            between = sum(len(v) * (mean(v) - above(k)[0]) ** 2 for k, v in parts.items())
            own = sum(len(v) ** 2 / above(k)[1] for k, v in parts.items())
            t2 = (between - many * s2) / (n - own)
            return s2 / t2 if t2 > 0 else Q.SAME

        at_host = strength(hosts, lambda k: (world, n), len(hosts) - 1)
        at_path = strength(paths, lambda k: (mean(hosts[k[:1]]), len(hosts[k[:1]])), len(paths) - len(hosts))
        logit = lambda x: math.log(x / (1 - x))
        out = []
        for r, o, x in zip(rows, odds, p):
            h, q = hosts[(r[2],)], paths[(r[2], r[3])]
            host = (sum(h) - x + at_host * world) / (len(h) - 1 + at_host)
            share = (sum(q) - x + at_path * host) / (len(q) - 1 + at_path)
            out.append(1 / (1 + math.exp(-(o + logit(share) - logit(world)))))
        return out

    return counts, scores


def test_classifier_equals_brute_force(spark):
    import numpy as np

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("doc_id < 500")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    # Sites that differ: hosts by quality, some of one document, null ones.
    docs = docs.join(labels, "doc_id", "left").selectExpr("doc_id", "text", "CASE WHEN doc_id % 9 = 0 THEN NULL WHEN quality = 0 OR doc_id % 4 = 1 THEN 'low' ELSE 'h' || doc_id % 7 END AS source", "CASE WHEN doc_id % 11 = 0 THEN NULL ELSE lang END AS lang")
    fit = quality_classifier.QualityClassifier(docs, labels)
    rows = [(r["doc_id"], r["text"], r["source"], r["lang"]) for r in docs.collect()]
    quality = {r["doc_id"]: r["quality"] for r in labels.collect()}
    counts, scores = classified(rows, quality)
    fold = {r["doc_id"] for r in docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0).select("doc_id").collect()}
    good, bad = counts([(t or "", quality[i] > 0) for i, t, _, _ in rows if i in quality and i not in fold])
    for half in quality_classifier.KINDS:
        g, b = good[half], bad[half]
        both = (g + b) / (g.sum() + b.sum())
        assert np.allclose(fit.weights[half], np.log((g + 1 + 20 * both) / (g.sum() + len(g) + 20)) - np.log((b + 1 + 20 * both) / (b.sum() + len(b) + 20)))
    got = {r["doc_id"]: (r["score"], r["kept"]) for r in fit.classify(docs).collect()}
    want = scores(fit)
    assert len(got) == len(rows)
    for r, x in zip(rows, want):
        assert got[r[0]][0] == pytest.approx(x, abs=1e-6) and got[r[0]][1] == (got[r[0]][0] >= 0.5)


def test_classifier_without_labels_or_words(spark):
    docs = spark.createDataFrame([(1, None, None, None, 1), (2, "", "h", "p", 1), (None, "some text", "h", "p", 1), (3, "x", "h", "p", 1), (3, "x", "h", "p", 1)], "doc_id long, text string, source string, lang string, evidence int")
    labels = spark.createDataFrame([(9, 1), (None, 0)], "doc_id long, quality int")
    out = quality_classifier.QualityClassifier(docs, labels).classify(docs).collect()
    assert len(out) == 5 and all(r["kept"] for r in out)
    assert quality_classifier.QualityClassifier(docs, labels).classify(docs.limit(0)).count() == 0


