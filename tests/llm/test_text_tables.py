"""Per-text operators: BPE, quality rules, WARC, URL filter, language ID, HTML text."""

import base64
import collections
import gzip
import hashlib
import re

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__ as E
from pickwise.llm import bpe, html, langid, quality, urls, warc

SMALL, MID = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
DOCS = "doc_id long, text string, lang string, source string"
LONG = "word " * 60_000


def run(spark, key, sf=SMALL):
    return E.queries()[key](spark, sf).collect()


def docs(spark, rows, schema=DOCS):
    return spark.createDataFrame(rows, schema)


# ---- operator 1

@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(bpe.Vocabulary(bpe.read_ranks(RANKS), public_tokenizers.PATTERN))


@pytest.fixture(scope="module")
def library():
    ranks = {t: i for i, t in enumerate(bpe.read_ranks(RANKS))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_perfect_hash_is_minimal_and_exact():
    keys = bpe.read_ranks(RANKS)
    h = bpe.PerfectHash(keys)
    assert sorted(h.slots) == list(range(len(keys)))
    assert all(h.index(k) == i for i, k in enumerate(keys))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from("  \n\t'sltreaéß漢1٣.!")), max_size=60))
def test_bpe_equals_the_library_and_round_trips(encoder, library, text):
    packed = encoder.encode(text)
    assert np.frombuffer(packed, "<u4").tolist() == library.encode_ordinary(text)
    assert encoder.decode(packed) == text.encode()


def test_long_pretoken_without_spaces(encoder, library):
    text = "abcde" * 8_000
    assert np.frombuffer(encoder.encode(text), "<u4").tolist() == library.encode_ordinary(text)


def test_op1_over_the_table(spark, library):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    got = run(spark, "op1_byte_bpe")
    assert len(got) == len(texts)
    for r in got:
        ids = library.encode_ordinary(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_op1_edges(spark):
    df = docs(spark, [(1, None, None, None), (1, "", "x", "y"), (None, "hi", None, None), (2, "hi", None, None), (2, "hi", None, None)])
    got = bpe.digests(df, RANKS, public_tokenizers.PATTERN).collect()
    empty = hashlib.sha256(b"").hexdigest()
    assert sorted((r["doc_id"] or 0, r["n_tokens"]) for r in got) == [(0, 1), (1, 0), (1, 0), (2, 1), (2, 1)]
    assert all(r["ids_sha256"] == empty == r["decoded_sha256"] for r in got if r["n_tokens"] == 0)
    clash = df.withColumn("token_ids", F.lit(5))
    coded = bpe.decode(bpe.encode(clash, RANKS, public_tokenizers.PATTERN), RANKS, public_tokenizers.PATTERN)
    assert coded.columns == ["doc_id", "text", "lang", "source", "token_ids", "decoded"]
    assert all(bytes(r["decoded"]) == (r["text"] or "").encode() for r in coded.collect())
    assert bpe.digests(df.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


# ---- operator 3

def brute_repeats(words):
    at = collections.defaultdict(list)
    for i in range(len(words) - 4):
        at[tuple(words[i:i + 5])].append(i)
    return len({i + k for own in at.values() if len(own) > 1 for i in own for k in range(5)})


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=40))
def test_repeat_words_equals_brute_force(words):
    assert quality.repeat_words(words) == brute_repeats(words)


def test_quality_edges_and_junk(spark):
    fine = [(i, " ".join(f"w{i}x{j}" for j in range(40)), "en", "s") for i in range(30)]
    junk = [(100, " ".join(f"w{j}###" for j in range(40)), "en", "s"), (101, None, None, None), (102, "", "en", "s"), (103, "same words here again now " * 30, "en", "s"), (104, LONG, "en", None)]
    df = docs(spark, fine + junk).withColumn("kept", F.lit("clash")).withColumn("n_words", F.lit("clash"))
    out = quality.judge(df)
    assert out.columns.count("kept") == 1 and out.columns.count("n_words") == 1
    got = {r["doc_id"]: r for r in out.collect()}
    assert len(got) == 35 and all(got[i]["kept"] for i in range(30))
    assert got[100]["failed_ratio"] == "symbol_ratio" and not got[100]["kept"] and not got[100]["base_failed"]
    assert all(got[i]["base_failed"] and not got[i]["kept"] for i in (101, 102, 103, 104))
    assert got[104]["n_words"] == 60_000 == got[104]["n_repeat_words"]
    assert quality.judge(df.limit(0)).count() == 0


# ---- operator 5

def test_warc_round_trip_edges(spark):
    body = "<p>é漢</p>\r\n\r\nWARC/1.0\r\n"
    rows = [(1, "http://a/x\r\ny", body), (7, "http://b/", body), (3, None, None), (4, "u", ""), (5, "http://c/", "x" * 300_000), (6, "v", "solo")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload_digest", F.lit(1))
    got = {r["page_id"]: r for r in warc.round_trip(pages).collect()}
    assert len(got) == len(rows)
    for page, _, text in rows:
        raw = (text or "").encode()
        assert got[page]["payload_bytes"] == len(raw)
        assert got[page]["payload_digest"] == base64.b32encode(hashlib.sha1(raw).digest()).decode()
    assert {p: (r["record_type"], r["refers_to"]) for p, r in got.items()} == {
        1: ("revisit", 7), 7: ("response", None), 3: ("revisit", 4), 4: ("response", None), 5: ("response", None), 6: ("response", None)}
    least = {r["page_id"]: r["record_type"] for r in warc.round_trip(pages, least_bytes=1).collect()}
    assert least[3] == least[4] == "response" and least[1] == "revisit"
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_normalised_archives_and_index(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://h/{i}", f"page {i} " * (i + 1)) for i in range(120)], "page_id long, url string, html string").repartition(3)
    warc.write_archives(warc.with_revisits(pages), f"{tmp_path}/mono")
    mono = next((tmp_path / "mono").glob("*.gz")).read_bytes()
    first = gzip.zlib.decompressobj(31)
    first.decompress(mono)
    assert first.unused_data == b""  # one stream for the whole file
    warc.normalise(spark, f"{tmp_path}/mono", f"{tmp_path}/members")
    raw = {p.parent.name.removeprefix("archive="): p.read_bytes() for p in (tmp_path / "members" / "kind=warc").glob("*/*.txt")}
    index = warc.read_index(spark, f"{tmp_path}/members").collect()
    assert len(index) == 120
    for r in index:
        record = gzip.decompress(raw[r["archive"]][r["offset"]:r["offset"] + r["length"]])
        assert record.startswith(b"WARC/1.0\r\n") and r["id"].encode() in record and record.count(b"WARC/1.0") == 1
    assert sum(len(gzip.decompress(x)) for x in raw.values()) == sum(len(gzip.decompress(p.read_bytes())) for p in (tmp_path / "mono").glob("*.gz"))


def test_cut_off_archive_is_an_error():
    whole = gzip.compress(b"WARC/1.0\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n")
    assert [b for _, _, b in warc.records(whole)] == [b"hello"]
    with pytest.raises(ValueError):
        list(warc.records(whole[:-12]))


# ---- operator 6

def test_url_rules_and_terms(spark):
    rows = [(1, "https://www.Example.org/es/1"), (2, "http://example.org/en/123?x"), (3, "http://a.com/fr/x"), (4, "http://b.com/de/"), (5, None), (6, "no scheme"),
            (7, "http://m.casino-win.example.net/a"), (8, "http://x.net/cheap-pills"), (9, "http://x.net/cheap"), (10, "http://x.net/cheapest-pillsbury"),
            (11, "http://org"), (12, "ftp://h.net?a/b"), (13, "http://x.net/" + "a" * 200_000), (1, "https://www.Example.org/es/1")]
    df = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit("clash"))
    out = urls.judge(df, keep=["page_id", "host"])
    got = {r["page_id"]: r for r in out.collect()}
    assert out.count() == 14 and out.columns.count("host") == 1
    assert (got[1]["host"], got[1]["path"], got[1]["rule"], got[1]["verdict"]) == ("www.example.org", "/es/1", "example.org/es/", "block")
    assert [got[i]["verdict"] for i in range(2, 13)] == ["block", "allow", "block", "allow", "allow", "block", "block", "allow", "allow", "allow", "allow"]
    assert got[5]["host"] == got[6]["path"] == "" and got[11]["rule"] is None and got[12]["host"] == "h.net"
    assert urls.judge(df.limit(0)).count() == 0


# ---- operator 7

def test_language_id_held_out_accuracy(spark):
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{MID}/documents.parquet").collect()}
    got = run(spark, "op7_language_id", MID)
    assert len(got) == len(truth)
    held = [r for r in got if r["held_out"]]
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_id_edges_and_probabilities(spark):
    rows = [(i, "the cat and the dog ran to the house " * 3 + str(i), "en", "s") for i in range(30)] + [
        (50 + i, "der hund und die katze liefen in das haus " * 3 + str(i), "de", "s") for i in range(30)] + [(90, None, "en", "s"), (91, "no label", None, "s")]
    model = langid.fit(docs(spark, rows))
    assert model.languages == ["de", "en"]
    ask = docs(spark, [(1, "the dog", "zz", None), (2, "die katze", None, None), (3, None, "en", None), (4, "123 ²½ ...", "en", None), (5, "", None, None),
                       (6, "the dog " * 40_000, None, None), (7, "漢字 кот", None, None)]).withColumn("score", F.lit("clash"))
    out = langid.predict(ask, model)
    got = {r["doc_id"]: r for r in out.collect()}
    assert out.columns.count("score") == 1 and got[1]["lang_pred"] == got[6]["lang_pred"] == "en" and got[2]["lang_pred"] == "de"
    assert all(got[i]["lang_pred"] == "und" and got[i]["rejected"] for i in (3, 4, 5))
    assert got[7]["lang_pred"] in model.languages and got[6]["events"] == 80_000 * 4
    none = langid.fit(docs(spark, rows).limit(0))
    assert [r["lang_pred"] for r in langid.predict(ask, none).collect()] == ["und"] * 7


def test_kneser_ney_sums_to_one():
    """Interpolated probabilities of one context add up to 1 less the mass of unseen characters."""
    words = collections.Counter("abracadabra abba bacad cabra dab".split())
    grams = collections.Counter()
    for w, n in words.items():
        for _, g in langid._grams(w, 3):
            grams[g] += n
    probs, backs = langid._one_language(list(grams.items()), 3)
    alphabet = {g[-1] for p in probs for g in p}
    for ctx in ("ab", "br", "\x02a"):
        total = sum(probs[3].get(ctx + c) or backs[2][ctx] * langid._lower(probs, backs, ctx[1:] + c, len(alphabet)) for c in alphabet)
        assert 0.9 < total <= 1 + 1e-9


# ---- operator 9

def test_op9_is_the_article(spark):
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{MID}/pages.parquet").collect()}
    got = run(spark, "op9_html_text", MID)
    assert len(got) == len(pages)
    for r in got:
        inner = re.search(r"<article>(.*?)</article>", pages[r["page_id"]]["html"], re.S)[1]
        text = re.sub(r"<[^>]+>", "", re.sub(r"</?(br|p|h1)\b[^>]*>", " ", inner))
        assert r["text"] == " ".join(html.entities.unescape(text).split()) and r["n_chars"] == len(r["text"])


STORY = "It was the best of days for the people of the town, and they all went to the river with what they had in their hands. " * 3


@pytest.mark.parametrize("around", [
    "<nav>Home</nav>{}<footer>the end of the page is here</footer>", "<div class='cookie-notice'>We use it for all of you and the rest</div>{}",
    "{}<div id=comments><p>" + STORY + "</p></div>", "<aside>" + STORY + "</aside>{}", "{}<form>" + STORY + "<input></form>",
    "<div class=sidebar><p>" + STORY + "</p></div>{}", "<header>The site of it</header>{}", "{}<script>if (a < b) { '</p>' }</script><style>p{{}}</style>",
    "<ul><li><a href=x>The first of the links</a></li><li><a href=y>and the rest</a></li></ul>{}"])
def test_boilerplate_around_an_unmarked_article(around):
    page = "<html><body>" + around.replace("{}", f"<h2>The title</h2><p>{STORY}</p><p>Short.</p><p>{STORY}&amp;</p>").replace("{{}}", "{}") + "</body></html>"
    assert html.main_text(page) == " ".join(f"The title {STORY} Short. {STORY}&".split())


def test_the_mark_is_evidence_not_the_verdict():
    told = f"{STORY} {STORY}".split()
    card = "<article><h3>Next</h3><p>A short card.</p></article>"
    assert html.main_text(f"<div><p>{STORY}</p><p>{STORY}</p></div><ul><li><a href=x>More of it</a></li></ul>{card}").split()[:len(told)] == told
    assert html.main_text(f"<main><p>{STORY}</p><p>{STORY}</p><p><a href=x>One link</a></p><p>keyword phone tablet laptop camera printer keyboard monitor speaker headset charger</p>"
                          "<p><a href=y>Two links</a></p></main>").split() == told
    assert html.main_text(f"<article><p>{STORY}</p><p>Short.</p><p>{STORY}</p></article><p><a href=x>All</a></p><p>{STORY}</p>") == " ".join(f"{STORY} Short. {STORY}".split())
    assert html.main_text("<article><p>keyword phone tablet laptop camera printer keyboard monitor speaker headset charger</p></article><p>x</p>").startswith("keyword")


def test_a_container_with_most_of_the_text_is_no_junk_by_a_part_of_its_name():
    told = " ".join(f"{STORY} {STORY}".split())
    for around in ("<div class='content no-sidebar'>{}</div>", "<article class='post comments-open'>{}</article>", "<b><div id=page-with-sidebar>{}</b>"):
        assert html.main_text(around.replace("{}", f"<p>{STORY}</p><div class='share-box'>Tell it to all</div><p>{STORY}</p>")) == told
    assert html.main_text(f"<p>{STORY}</p><p>{STORY}</p><div class='left-sidebar'><p>{STORY}</p></div>") == told
    assert html.main_text(f"<p>Short.</p><div class='comments'><p>{STORY}</p></div>") == "Short."


def test_op9_without_the_mark(spark):
    """On pages whose mark is taken away, most blocks of the article are still found by the two passes."""
    found = whole = 0
    for r in spark.read.parquet(f"{MID}/pages.parquet").collect():
        want = html.main_text(r["html"])
        got = html.main_text(re.sub("</?article>", "", r["html"]))
        assert set(got.split()) <= set(want.split())    # nothing from menus, adverts or footers
        found, whole = found + len(got), whole + len(want)
    assert found >= 0.8 * whole


def test_html_edges(spark):
    assert html.main_text("<p>a<b>b</b>c&nbsp;&#233;\n d") == "abc é d"
    assert html.main_text("<article>one<p>two<p>three</article>x") == "one two three"
    assert html.main_text("a < b") == "a < b" and html.main_text("<!-- open") == "" and html.main_text("<script>x") == ""
    rows = [(1, "u", None), (2, None, ""), (3, "u", "<article>" + "<p>word</p>" * 50_000 + "</article>"), (3, "u", "<p>x</p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = html.extract(df).collect()
    assert sorted(r["n_chars"] for r in got) == [0, 0, 1, 249_999] and html.extract(df).columns.count("text") == 1
    assert html.extract(df.limit(0)).count() == 0
