"""Training-data operators against brute force on small fixtures with nulls,
empty and very long texts, repeated rows, clashing columns and empty tables."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptlens.llm import (components, decontam, html, langid, ngram_join, numbering, packing, pii, quality,
                            shuffle, tokens, toxicity, training_order)

# an extra column of each name that the operators use inside
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, size int, bucket string, "
          "slot string, ids string, body string, token string, label string, id string, start string")
LONG = " ".join(f"w{i % 700}x{i}" for i in range(30_000))
NEAR = " ".join(f"term{i}" for i in range(200))


def edited(text, at, word="zzz"):
    words = text.split(" ")
    words[at] = word
    return " ".join(words)


ROWS = [
    (1, "The quick brown fox jumps over the lazy dog again and again today", "en", "a"),
    (2, None, None, None),
    (3, "", "en", "a"),
    (4, "   \n\t ", None, "b"),
    (5, LONG, "en", "a"),
    (6, NEAR, "en", None),
    (7, edited(NEAR, 100), "en", "c"),
    (8, NEAR, "de", "a"),
    (9, edited(edited(NEAR, 0), 199), "en", "a"),
    (10, "mail bob@example.com or +1 (212) 555-0100 from 10.0.0.1 card 4111 1111 1111 1111 ok", "en", "a"),
    (11, "two words", "en", "a"),
    (12, "Two words", "en", "a"),
    (12, "Two words", "en", "a"),
    (None, "a row without an id and with words", "en", "a"),
    (None, None, None, None),
    (9_007_199_254_740_995, "a large id: " + "same line\n" * 12, "en", "a"),
    (13, "Ärger über Öl \U0001F600 ça va? <|endoftext|> it's 12 34", "de", "a"),
    (14, NEAR.upper(), "en", "a"),
    (15, "### $$$ %%% &&& *** ||| <<< >>> one two", "en", "a"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, g, s, len(t or ""), 7, "x", "y", "z", "b", "t", "l", "i", "s") for i, t, g, s in ROWS]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def bag(rows):
    return collections.Counter(rows)


# --- quality -------------------------------------------------------------------

def brute_quality(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    windows = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
    seen = collections.Counter(windows)
    covered = {i + k for i, x in enumerate(windows) if seen[x] > 1 for k in range(5)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))


def test_quality_counts(docs, empty):
    got = quality.quality_rules(docs).collect()
    assert bag((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == \
        bag((i, *brute_quality(t)) for i, t, _, _ in ROWS)
    verdict = {r.doc_id: (r.base_failed, r.kept) for r in got}
    assert verdict[3] == (True, False) and verdict[1] == (False, True) and verdict[15][1] is False
    assert quality.quality_rules(empty).count() == 0


def test_quality_rules_are_a_table(docs):
    strict = quality.quality_rules(docs, (quality.Rule("length", "n_words", 1_000, None),))
    assert {r.doc_id for r in strict.where("kept").collect()} == {5}


# --- personal data ---------------------------------------------------------------

def test_pii_base_spans_match_plain_patterns():
    for text in [t or "" for _, t, _, _ in ROWS] + ["a@b.c@d.e f@@g.h x@y.z.@q", "é1@é.com a@b.com", "@a.b",
                                                   "1.2.3.4.5.6.7.8 999.1.1.1", "4111-1111-1111-1112 +49 30 1234567"]:
        plain = [(m.start(), 0, m.end()) for m in pii.EMAIL.finditer(text)]
        plain += [(m.start(), 1, m.end()) for m in pii.IP.finditer(text)
                  if all(int(p) <= 255 for p in m.group().split("."))]
        plain += [(m.start(), 2, m.end()) for m in pii.CARD.finditer(text)
                  if 14 <= len(pii.digits_of(m.group())) <= 19 and pii.luhn(pii.digits_of(m.group()))]
        plain += [(m.start(), 3, m.end()) for m in pii.PHONE.finditer(text)
                  if 10 <= len(pii.digits_of(m.group())) <= 15]
        assert pii.base_spans(text) == sorted(plain)


def test_pii_spans_and_masking(docs, empty):
    found = {r.doc_id: r.pii for r in pii.find_spans(docs, keep=["doc_id"]).collect()}
    assert [(s.kind, s.base) for s in found[10]] == [("email", True), ("phone", True), ("ip", True), ("card", True)]
    assert found[2] == [] and found[3] == [] and found[9_007_199_254_740_995] == []
    out = pii.mask_texts(docs)
    assert out.columns == docs.columns
    masked = {r.doc_id: r.text for r in out.collect()}
    assert masked[10] == "mail [EMAIL] or [PHONE] from [IP] card [CARD] ok"
    assert masked[2] is None and masked[1] == ROWS[0][1] and masked[5] == LONG
    assert pii.find_spans(empty).count() == 0


@pytest.mark.parametrize("seed", [77, 101, 502])
def test_pii_added_spans_held_out(seed):
    """What the query and the mask return: most of the spans that the patterns
    miss, hardly any other ones. Lines of other seeds than the training's."""
    model = pii.trained()
    rng = np.random.default_rng(seed)
    lines = [pii.labelled_example(rng) for _ in range(300)]
    missed = hit = extra = 0
    for (text, labels), spans in zip(lines, pii.spans_of([t for t, _ in lines], model)):
        base = pii.base_spans(text)
        added = {(s["start"], s["end"], pii.KINDS.index(s["kind"])) for s in spans if not s["base"]}
        left = {x for x in labels if not any(x[0] < e and b < x[1] for b, _, e in base)}
        missed, hit, extra = missed + len(left), hit + len(added & left), extra + len(added - set(labels))
    assert missed > 100 and hit >= 0.8 * missed
    assert hit >= 0.95 * (hit + extra)


def test_pii_plain_notations_are_found_and_masked(spark):
    texts = ["call (030) 555-1234 today", "the host 192[.]168[.]1[.]20 is up", "(030) 555-1234", "192[.]168[.]1[.]20",
             "nothing here", "version 1.2.3 of 12.5.2020, page 17", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r.doc_id: r.text for r in pii.mask_texts(df).collect()}
    assert [out[k] for k in range(4)] == ["call [PHONE] today", "the host [IP] is up", "[PHONE]", "[IP]"]
    assert [out[k] for k in (4, 5, 6)] == texts[4:]


def test_pii_long_run_in_pieces_equals_the_whole():
    model = pii.trained()
    rng = np.random.default_rng(4)
    text = " ".join(pii.labelled_example(rng)[0] for _ in range(60))
    numbers = " ".join(str(int(x)) for x in rng.integers(0, 10 ** 9, 900))
    for t in (text, numbers, numbers[:2000] + text + numbers[:999], "1" * 5000, "(030) 555-1234 " * 300):
        whole = [s[:3] for s in pii.tagged_spans([t], model, 100_000)[0]]
        for block in (1, 7, 64):
            assert [s[:3] for s in pii.tagged_spans([t, "short 1"], model, block)[0]] == whole
    run = pii.runs_of(numbers)[0]
    seen = [set()]
    tags, margins = pii.long_path(model, [numbers], (0, *run), 5, seen)
    (want, want_margins), = pii.decode(model, pii.run_scores(model, [numbers], [(0, *run)], 10_000, [set()]))
    assert (tags == want).all() and np.allclose(margins, want_margins, atol=1e-4)


def test_pii_very_long_digit_text_needs_bounded_memory():
    import tracemalloc

    model = pii.trained()
    text = " ".join(str(k * 7919 % 100_003) for k in range(18_000))
    tracemalloc.start()
    pii.spans_of([text], model)
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert len(text) > 90_000 and peak < 60 << 20


@pytest.mark.parametrize("size", [20, 40, 50, 63, 64, 200, 1000])
def test_pii_spans_are_found_at_every_alignment(size, monkeypatch):
    # a tagger that is sure of "<" and the capitals and at sign after it
    def sure(m, codes):
        e = np.zeros((codes.shape[1], codes.shape[0], pii.TAGS), np.float32)
        first, inner = codes.T == pii.char_codes("<")[0], np.isin(codes.T, pii.char_codes("A@"))
        e[..., 1], e[..., 2] = np.where(first, 9, -9), np.where(inner, 9, -9)
        return e

    monkeypatch.setattr(pii, "emissions", sure)
    model = {"trans": np.zeros((pii.TAGS, pii.TAGS), np.float32)}     # tagged_spans needs no more
    half = "A" * (size // 2)
    span = "<" + half + "@" + half
    for at in range(pii.STRIDE):
        for after in ("", "z" * 300):
            text = "x" * (320 + at) + span + after
            got = [x[:3] for x in pii.tagged_spans([text, "no mark", text[:-3] + " 1"], model, 8)[0]]
            assert got == [(320 + at, 320 + at + len(span), 0)]


def test_pii_long_notations_do_not_hang_on_their_offset():
    model = pii.trained()
    address = "first.last (@) department.university.example.com"
    hits = 0
    for at in range(pii.STRIDE):
        text = "word " * 20 + "x" * at + " " + address + " and some more words to the end of the line"
        start = text.index(address)
        hits += any(a <= start and start + len(address) <= z for a, z, _, _ in pii.tagged_spans([text], model)[0])
    assert hits == pii.STRIDE
    rng = np.random.default_rng(78)
    hit = wrong = missed = 0
    for _ in range(300):
        text, labels = pii.labelled_example(rng)
        got = {(a, z, k) for a, z, k, _ in pii.tagged_spans([text], model)[0]}
        hit, wrong, missed = hit + len(got & set(labels)), wrong + len(got - set(labels)), missed + len(set(labels) - got)
    assert hit / (hit + wrong) > 0.65 and hit / (hit + missed) > 0.65


def test_pii_spans_never_overlap_and_cross_windows():
    text = "x" * 60 + " call (030) 555-1234 now " + "y" * 50
    model = pii.trained()
    spans = pii.tagged_spans([text], model)[0]
    assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
    assert pii.schedule([(0, 5, 0, 1.0), (4, 9, 0, 3.0), (9, 12, 1, 1.0)]) == [(4, 9, 0, 3.0), (9, 12, 1, 1.0)]


# --- web pages ---------------------------------------------------------------------

PAGES = [
    (1, "http://a.com/1", "<html><head><title>T</title><style>p{}</style><script>var t='</p>';</script></head><body>"
     "<nav><ul><li>Home</li></ul></nav><div class=\"ad\">Buy!</div><article><h1>Head &amp; line</h1><p>One <b>two</b>\n"
     "three&nbsp;four<br>five</p><p>a &lt; b</p><div class='comments'>nice</div></article><footer>&copy; x</footer>"),
    (2, "http://a.com/2", None), (3, None, ""), (4, "http://a.com/4", "<p>plain"),
    (5, "http://a.com/5", "<article><form>q</form><p>text</p><aside>side</aside><p>end"),
    (5, "http://a.com/5", "<article><form>q</form><p>text</p><aside>side</aside><p>end"),
] + [(100 + i, f"http://h{i % 2}.com/{i}",
      "<body><div>welcome to our very great site please do sign the guest book</div>"
      f"<div><p>unique text {i} about w{i} x{i} y{i} z{i} q{i} r{i}</p></div>") for i in range(10)]


def test_pages(spark):
    df = spark.createDataFrame([(*p, "t", "h") for p in PAGES],
                               "page_id long, url string, html string, text string, page_key string")
    got = bag((r.page_id, r.text) for r in html.main_text(df).collect())
    want = {1: "Head & line\nOne two three four five\na < b", 2: "", 3: "", 4: "plain", 5: "text\nend"}
    want |= {100 + i: f"unique text {i} about w{i} x{i} y{i} z{i} q{i} r{i}" for i in range(10)}
    assert got == bag((p[0], want[p[0]]) for p in PAGES)
    assert html.main_text(df.limit(0)).count() == 0


def words(name, n=12):
    return " ".join(f"{name}{j}" for j in range(n))


FURNITURE = ["<section class='comments'><p>{}</p></section>", "<div id=commentList>{}</div>", "<ol class=replies><li>{}</ol>",
             "<div class='cookie-notice'>{}</div>", "<div class='notice'><p>{}</p></div>", "<div class=sidebar><p>{}</p></div>",
             "<aside>{}</aside>", "<div class='ad'>{}</div>", "<p class=\"advert\">{}</p>", "<div class='sponsored box'>{}</div>",
             "<div class=newsletter>{}</div>", "<ul class='main-menu'><li>{}</li></ul>", "<form>{}</form>",
             "<div role=alert>{}</div>", "<div class='related'><article>{}</article></div>", "<footer><p>{}</p></footer>"]


@pytest.mark.parametrize("n", [3, 7, 8, 50])
def test_named_furniture_goes_at_any_length(spark, n):
    """Unique and repeated, beside and inside an article, and without one."""
    rows, want = [], {}
    for k, frame in enumerate(FURNITURE):
        for same in (True, False):
            for i in range(2):
                part = frame.format(words("same" if same else f"own{k}_{i}_", n))
                for place, page in enumerate(("{part}<article><p>{body}</p></article>",
                                              "<article><p>{body}</p>{part}<p>end{k}</p></article>",
                                              "<div><p>{body}</p></div>{part}")):
                    key = len(rows)
                    body = words(f"body{key}_", 9)
                    rows.append((key, f"http://h{k}.com/{key}", page.format(part=part, body=body, k=k)))
                    want[key] = body + (f"\nend{k}" if place == 1 else "")
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    assert {r.page_id: r.text for r in html.main_text(df).collect()} == want


def test_wrappers_headers_and_nested_articles():
    text = html.page_text
    assert text("<div class='has-sidebar nav-page'><article>kept</article><p>gone</p></div>", None) == "kept"
    assert text("<div class='page-header'>gone</div><article><header class='header'><h1>kept</h1></header>", None) == "kept"
    assert text("<article>kept<div class='sidebar'><article>gone</article></div></article>", None) == "kept"
    assert text("<div class='siteHeader'>gone</div><div class=story>kept</div>", None) == "kept"


def slow_main_text(rows, depth=8):
    """Runs and coverage by comparing all places of all pages of a host."""
    parsed = {k: html.blocks_of(page) for k, _, page in rows}
    seen = collections.defaultdict(set)
    for k, host, _ in rows:
        tokens = [t for _, text in parsed[k] for t in text.split(" ")]
        content = "\n".join(t for z, t in parsed[k] if z != "chrome")
        for i in range(len(tokens) - depth + 1):
            seen[host, tuple(tokens[i:i + depth])].add(content)
    out = {}
    for k, host, _ in rows:
        tokens = [t for _, text in parsed[k] for t in text.split(" ")]
        owner = [b for b, (_, text) in enumerate(parsed[k]) for _ in text.split(" ")]
        is_open = [z == "open" for z, _ in parsed[k]]
        hit = set()
        for i in range(len(tokens) - depth + 1):
            if len(seen[host, tuple(tokens[i:i + depth])]) > 1 and any(is_open[b] for b in owner[i:i + depth]):
                hit |= set(range(i, i + depth))
        kept = []
        for b, (zone, text) in enumerate(parsed[k]):
            own = [i for i, o in enumerate(owner) if o == b]
            if zone == "main" or zone == "open" and len(hit & set(own)) < 0.8 * len(own):
                kept.append(text)
        out[k] = "\n".join(kept)
    return out


def test_main_text_equals_brute_force(spark, monkeypatch):
    """Open blocks decided by runs, beside articles and without, over several arrays."""
    rng = np.random.default_rng(9)
    parts = [words(f"shared{j}_", int(rng.integers(2, 15))) for j in range(12)]
    rows = []
    for k in range(60):
        blocks = [f"<div>{parts[j]}</div>" if rng.random() < 0.5 else f"<p>{words(f'u{k}_{j}_', int(rng.integers(1, 14)))}</p>"
                  for j in rng.integers(0, 12, 6)]
        if k % 3 == 0:
            blocks.insert(2, f"<article><p>{parts[k % 12]}</p><p>{words(f'art{k}_')}</p></article>")
        if k % 4 == 0:
            blocks.insert(1, f"<nav>{parts[3]}</nav>")
        rows.append((k, f"h{k % 3}.com", "".join(blocks)))
    rows += [(100, "h0.com", rows[0][2]), (101, "h1.com", "<p>" + words("long", 30_000) + f"</p><p>{parts[0]}</p>"),
             (102, "h9.com", "<article>alone")]
    df = spark.createDataFrame([(k, f"http://{h}/{k}", p, "t", 1, "r") for k, h, p in rows],
                               "page_id long, url string, html string, tokens string, at int, run string").repartition(5)
    monkeypatch.setattr(html, "ARRAY_TOKENS", 400)
    got = {r.page_id: r.text for r in html.main_text(df).collect()}
    assert got == slow_main_text(rows)
    assert sum(p.count("shared") > got[k].count("shared") for k, _, p in rows) > 20     # the runs had work


def test_repeated_runs_equal_brute_force_across_arrays(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = []
    for k in range(40):
        words = [f"u{k}_{j}" for j in range(20)]
        if k % 3 == 0:
            words[5:15] = [f"shared{j}" for j in range(10)]
        rows.append((f"h{k % 2}", k, int(rng.integers(1 << 40)), [hash((w,)) % (1 << 50) for w in words]))
    df = spark.createDataFrame(rows, "page_host string, page_key long, page_sig long, tokens array<long>")
    monkeypatch.setattr(html, "ARRAY_TOKENS", 60)
    got = {(r.page_host, r.run) for r in html.repeated_runs(df).collect()}
    seen = collections.defaultdict(set)
    for host, _, sig, toks in rows:
        for run in html.run_hashes(np.array(toks, dtype=np.int64)):
            seen[host, int(run)].add(sig)
    assert got == {k for k, v in seen.items() if len(v) > 1} and got


# --- sharding ------------------------------------------------------------------------

def test_shards(docs, empty):
    rows = shuffle.external_shuffle(docs).collect()
    assert len(rows) == len(ROWS)
    assert bag((r.doc_id, r["size"], r.text_crc32) for r in rows) == bag(
        (i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _, _ in ROWS)
    counts = bag(r.shard for r in rows)
    assert max(counts.values()) - min(counts.values()) <= 1 and len(counts) == shuffle.SHARDS
    for k in counts:
        assert sorted(r.slot for r in rows if r.shard == k) == list(range(counts[k]))
    again = shuffle.external_shuffle(docs.repartition(5)).collect()
    place = lambda rs: bag((r.doc_id, r.text_crc32, r.shard, r.slot) for r in rs)
    assert place(rows) == place(again)
    assert shuffle.external_shuffle(empty).count() == 0


def test_fisher_yates_is_a_permutation_and_fair():
    places = np.zeros((4, 4))
    for seed in range(2_000):
        order = shuffle.fisher_yates(4, seed, 0)
        assert sorted(order) == [0, 1, 2, 3]
        places[np.arange(4), order] += 1
    assert abs(places / 2_000 - 0.25).max() < 0.05


# --- languages ------------------------------------------------------------------------

EN = "the house and the garden were quiet when the children walked home from school in the evening"
DE = "das haus und der garten waren ruhig als die kinder am abend von der schule nach hause gingen"
RU = "дом и сад были тихими когда дети вечером шли домой из школы"


def test_language_spans(spark, docs, empty):
    rows = [(k, t, g) for k, (t, g) in enumerate([(EN, "en"), (DE, "de"), (RU, "ru")] * 12)]
    train = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(train, F.lit(True))
    mix = EN + " " + DE + " " + RU
    test = spark.createDataFrame([(1, EN, "x"), (2, mix, "x"), (3, None, "x"), (4, "12 34 !", "x"), (5, "½ ²", "x"),
                                  (None, DE, "x"), (6, RU + " ok", "x")], "doc_id long, text string, score string")
    got = {r.doc_id: r for r in langid.label_languages(test, model).collect()}
    assert got[1].lang_pred == "en" and got[None].lang_pred == "de" and got[6].lang_pred == "ru"
    assert [(s.lang, mix[s.start:s.end]) for s in got[2].spans] == [("en", EN), ("de", DE), ("ru", RU)]
    assert all(got[k].lang_pred == "und" and got[k].score == 0 for k in (3, 4, 5))
    assert all(0 <= r.score <= 1 for r in got.values())
    nothing = langid.train(train, F.lit(False))
    assert {r.lang_pred for r in langid.label_languages(test, nothing).collect()} == {"und"}
    assert langid.label_languages(empty, model).count() == 0


def test_viterbi_equals_brute_force():
    import itertools
    rng = np.random.default_rng(3)
    scores = rng.normal(size=(6, 2, 3)).astype(np.float32)
    lengths = np.array([4, 6])
    path = langid.viterbi(scores.copy(), lengths, 0.7)
    for b, n in enumerate(lengths):
        def value(p):
            return sum(scores[k, b, s] for k, s in enumerate(p)) - 0.7 * sum(x != y for x, y in zip(p, p[1:]))
        best = max(itertools.product(range(3), repeat=int(n)), key=value)
        assert value(path[:n, b].tolist()) == pytest.approx(value(best), abs=1e-4)


# --- decontamination ---------------------------------------------------------------------

def brute_hits(text, items, window=10):
    w = decontam.words_of(text)
    hit, found = set(), set()
    for name, t in items:
        v = decontam.words_of(t)
        n = min(window, len(v))
        for a in range(len(v) - n + 1 if v else 0):
            for p in range(len(w) - n + 1):
                if w[p:p + n] == v[a:a + n]:
                    hit |= set(range(p, p + n))
                    if name is not None:
                        found.add(str(name))
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("chunk_bytes", [1 << 20, 200])
def test_decontamination(spark, docs, empty, chunk_bytes):
    items = [(1, "quick brown fox"), (2, " ".join(f"TERM{i}" for i in range(95, 120))), (2, "two words"), (3, None),
             (4, "..."), (None, "a row without an id"), (5, " ".join(LONG.split(" ")[50:75])), (6, "absent phrase here")]
    bench = spark.createDataFrame([(*x, "e") for x in items], "item_id long, text string, n_words string")
    got = decontam.search_index(decontam.build_index(docs, block_tokens=500), bench, chunk_bytes=chunk_bytes).collect()
    want = bag((i, *map(str, brute_hits(t, items))) for i, t, _, _ in ROWS)
    assert bag((r.doc_id, str(r.n_words), str(r.n_hit), str(r["items"])) for r in got) == want
    assert decontam.decontaminate(empty, bench).count() == 0
    assert {r.n_hit for r in decontam.decontaminate(docs, bench.limit(0)).collect()} == {0}
    near = {r.doc_id: r.near_items for r in got}
    assert "1" in near[1] and "6" not in near[1]


# --- n-gram join ---------------------------------------------------------------------------

def brute_components(rows):
    def shingles(t):
        w = (t or "").encode().lower().split()
        k = min(4, len(w))
        return frozenset(tuple(w[a:a + k]) for a in range(len(w) - k + 1)) if w else frozenset()

    # a document is an id with its text
    nodes = sorted({(i, t) for i, t in rows if i is not None}, key=lambda n: (n[0], n[1] or ""))
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [(n, shingles(n[1])) for n in nodes]
    for k, (a, x) in enumerate(sets):
        for b, y in sets[:k]:
            if x and y and 100 * len(x & y) >= 85 * len(x | y):
                p, q = find(a), find(b)
                if p != q:
                    low, high = sorted((p, q), key=lambda n: n[0])
                    parent[high] = low
    return bag((i, len(shingles(t)), find((i, t))[0] if i is not None else None) for i, t in rows)


def test_ngram_components(docs, empty):
    got = ngram_join.similar_classes(docs).collect()
    assert bag((r.id, r.n_shingles, r.component_id) for r in got) == brute_components([(i, t) for i, t, _, _ in ROWS])
    assert ngram_join.similar_classes(empty).count() == 0


def test_ngram_components_of_copy_groups(spark, monkeypatch):
    # a large group of edited copies and a passage that many texts share
    monkeypatch.setattr(ngram_join, "LONG_LIST", 6)
    monkeypatch.setattr(ngram_join, "BLOCK_NODES", 8)
    monkeypatch.setattr(ngram_join, "SALT_ROWS", 10)
    rng = np.random.default_rng(9)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for k in range(90):
        words = list(base)
        for at in rng.choice(120, rng.integers(0, 4), replace=False):
            words[at] = f"e{k}_{at}"
        rows.append((1000 - k, " ".join(words)))
    for k in range(60):
        rows.append((2000 + k, " ".join(base[:30] + [f"u{k}_{i}" for i in range(rng.integers(2, 60))])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = ngram_join.similar_classes(df).collect()
    assert bag((r.id, r.n_shingles, r.component_id) for r in got) == brute_components(rows)


def test_texts_that_share_an_id_and_ids_of_text(spark, empty):
    """Links of either text under one id; ids that are no numbers."""
    rng = np.random.default_rng(12)
    base = [f"b{i}" for i in range(200)]
    other = [f"o{i}" for i in range(200)]

    def near(words, k):
        return " ".join([*words[:k], f"x{k}", *words[k + 1:]])

    rows = [(50, near(base, 3)), (50, near(other, 9)), (20, near(base, 40)), (70, near(other, 20)), (10, "alone in the world today"),
            (50, "alone in the world now"), (20, near(base, 40)), (30, None), (30, ""), (30, near(other, 58)), (None, near(base, 3))]
    rows += [(100 + k // 2, near(base if k % 2 else other, int(rng.integers(60)))) for k in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = ngram_join.similar_classes(df).collect()
    assert bag((r.id, r.n_shingles, r.component_id) for r in got) == brute_components(rows)
    assert len({r.component_id for r in got if r.id == 50}) == 3
    named = [(None if i is None else f"id-{i:04d}", t) for i, t in rows]
    got = ngram_join.similar_classes(spark.createDataFrame(named, "doc_id string, text string")).collect()
    assert bag((r.id, r.n_shingles, r.component_id) for r in got) == brute_components(named)
    # the component's document is one of its rows
    held = {(r.id, r.text_hash) for r in got}
    assert all(r.component_id is None or (r.component_id, r.component_hash) in held for r in got)


def test_the_frequency_table_keeps_its_bound(spark, monkeypatch):
    """Also when even the most frequent tokens are more than it holds."""
    rows = [(1, 0, 20_000 if k < 50 else 5 + k % 3, k) for k in range(200)]
    table = spark.createDataFrame([(kind, t, n) for kind, _, n, t in rows], "kind int, token long, n long")
    for bound in (10, 49, 50, 60, 120, 500):
        monkeypatch.setattr(ngram_join, "HEAVY_TOKENS", bound)
        token, n = ngram_join.frequent(table)
        assert len(token) == len(n) <= bound
        assert bound < 50 or set(range(50)) <= set(token.view(np.int64).tolist())
        assert bound >= 50 or (n == 20_000).all()
    assert len(ngram_join.frequent(table.limit(0))[0]) == 0


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 200), (200, 150), (300, 300)]
    got = {r.node: r.label for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 200: 100, 150: 100}


# --- toxicity ----------------------------------------------------------------------------

def test_toxicity_learns_and_ignores_identity(spark, docs, empty):
    rng = np.random.default_rng(1)
    rows, labels = [], []
    for i in range(400):
        toxic = i % 4 == 0
        words = [f"w{rng.integers(60)}" for _ in range(20)]
        if toxic:
            words[3] = rng.choice(["idiot", "scum"])
        if rng.random() < (0.8 if toxic else 0.1):      # a biased sample
            words[7] = rng.choice(["muslim", "gay"])
        rows.append((i, " ".join(words) + "."))
        labels.append((i, int(toxic)))
    rows.append((1000, None))
    text = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame(labels + [(None, 1), (7, None)], "doc_id long, toxic int")
    table = toxicity.sample_table(text, marks, F.col("doc_id") < 300, "doc_id", "text", "toxic", 1000).cache()
    fair, plain = toxicity.fit(table), toxicity.fit(table, counterfactual=0.0)
    word = toxicity.feature_ids("muslim")[0]
    neutral = toxicity.feature_ids("religious")[0]
    gap = lambda m: abs(m["w"][m["keep"][word]] - m["w"][m["keep"][neutral]])
    assert gap(fair) < 0.5 * gap(plain)
    got = {r.doc_id: r.toxic_score for r in toxicity.score(text, fair).collect()}
    held = [i for i in range(300, 400)]
    assert all((got[i] >= 0.5) == (i % 4 == 0) for i in held) and 0 <= got[1000] < 0.5
    one_class = toxicity.train(text, marks.where("toxic = 0"), F.lit(True))
    assert len({r.toxic_score for r in toxicity.score(text, one_class).collect()}) == 1
    out = toxicity.score(docs, fair)
    assert out.columns == [*docs.columns, "toxic_score"] and out.count() == len(ROWS)
    assert toxicity.score(empty, fair).count() == 0


def test_toxicity_gradient_equals_differences():
    rng = np.random.default_rng(3)
    n, f, k = 12, 7, 5
    rows_in, cols_in = np.repeat(np.arange(n), 3), rng.integers(0, f, 3 * n)
    y, length = rng.integers(0, 2, n).astype(float), rng.random(n)
    at, feature, sign = rng.integers(0, k, 14), rng.integers(0, f, 14), rng.choice([-1.0, 1.0], 14)
    point = rng.standard_normal(f + 2)

    def loss(x, what=0):
        return toxicity.loss_gradient(x[:f], x[f], x[f + 1], y, length, rows_in, cols_in, (at, feature, sign, k), 0.3, 0.7)[what]

    # by the plain formulas
    w = point[:f]
    s = np.array([w[cols_in[rows_in == r]].sum() for r in range(n)]) + point[f] * length + point[f + 1]
    p = 1 / (1 + np.exp(-s))
    change = [(sign[at == j] * w[feature[at == j]]).sum() for j in range(k)]
    plain = -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p)) + 0.15 * ((w ** 2).sum() + point[f] ** 2) + 0.7 * np.mean(np.square(change))
    assert loss(point) == pytest.approx(plain)
    step = 1e-6
    for j in range(f + 2):
        move = np.eye(f + 2)[j] * step
        assert (loss(point + move) - loss(point - move)) / (2 * step) == pytest.approx(loss(point, 1)[j], abs=1e-6)


def test_toxicity_swaps_compare_whole_sentences(spark):
    table = spark.createDataFrame([("Women praised women. A man, a plan!", 0), (None, 1), ("nobody", 0)], "body string, label int")
    others = {"women": ("men",), "man": ("woman", "person")}
    found = toxicity.swap_table(table, others, 100)
    ids = lambda *words: set().union(*map(toxicity.feature_ids, words))
    want = []
    for words, term, other in ((["women", "praised"], "women", "men"), (["a", "man", "plan"], "man", "woman"),
                               (["a", "man", "plan"], "man", "person")):
        before, after = ids(*words), ids(*(set(words) - {term} | {other}))
        want.append((sorted(before - after), sorted(after - before)))
    assert sorted(found) == sorted(want)
    assert len(toxicity.swap_table(table, others, 2)) == 2


def test_toxicity_finds_groups_of_the_corpus_and_penalises_them(spark):
    """Two neutral words with the same neighbours become a group; a biased sample
    gives one of them weight, which the swaps take away."""
    rng = np.random.default_rng(8)
    rows = []
    for i in range(600):
        toxic = i % 3 == 0
        town = "velda" if i // 3 % 2 else "morna"
        words = [f"{'abcdefgh'[j]}word" for j in rng.integers(0, 8, 6)]
        rows.append((f"{' '.join(words)}. people from {town} sing songs. {'vile scum' if toxic else 'kind folk'} here", int(toxic)))
    table = toxicity.sample_table(
        spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string"),
        spark.createDataFrame([(i, y) for i, (_, y) in enumerate(rows)], "doc_id long, toxic int"),
        F.lit(True), "doc_id", "text", "toxic", 1_000)
    groups = toxicity.corpus_groups(table, 200, 400)
    assert tuple(sorted(("velda", "morna"))) in {tuple(sorted(g)) for g in groups}
    assert all("scum" not in g and "kind" not in g for g in groups)
    model = toxicity.fit(table)
    assert model["swaps"] >= 600
    gap = abs(model["w"][model["keep"][toxicity.feature_ids("velda")[0]]] - model["w"][model["keep"][toxicity.feature_ids("morna")[0]]])
    assert gap < 0.2


# --- tokens, packing, training order -----------------------------------------------------------

def reference_ids(text):
    encoder = tokens.ChunkEncoder(tokens.tokenizer_path())
    return encoder.tokenizer.encode(text or "", add_special_tokens=False).ids + [tokens.EOS]


def test_chunk_encoder_equals_tokenizer():
    texts = [t for _, t, _, _ in ROWS if t != LONG] + [
        "a  b\tc\x1cd\x1f e", "İstanbul ΣΑΣ ς", "it's we'll 12 345", "é ́x\ńy  z w\x85v", "x" * 5000,
        "日本語 テキスト 한국어", "\r\n\r\n a"]
    rng = np.random.default_rng(2)
    marks = list(" \n\t\x0b\x1c ̸́aAeİΣ'st<|9é日\U0001F600")
    texts += ["".join(rng.choice(marks, 30)) for _ in range(200)]
    ids, ends = tokens.ChunkEncoder(tokens.tokenizer_path()).encode(texts)
    starts = [0, *ends[:-1]]
    assert [ids[a:z].tolist() for a, z in zip(starts, ends)] == [reference_ids(t) for t in texts]


def test_packing_plan_is_exact_and_tight():
    rng = np.random.default_rng(4)
    for lengths, slack in [([], 0), ([4096], 0), ([1], 0), (rng.integers(1, 4097, 3000), 0.02),
                           (rng.integers(1300, 1500, 2000), None), (np.full(5000, 1365), 0.001),
                           (np.minimum(4096, rng.lognormal(6.3, 1.2, 20_000).astype(int) + 1), 0.002)]:
        counts = np.bincount(np.asarray(lengths, dtype=np.int64), minlength=4097)
        runs, bins = packing.plan(counts)
        load, used = np.zeros(bins, dtype=np.int64), collections.defaultdict(list)
        pieces = [[] for _ in range(bins)]
        for length, rank, n, first, offset in runs:
            used[length].append((rank, n))
            for b in range(first, first + n):
                pieces[b].append((offset, length))
        for length, parts in used.items():
            parts.sort()
            assert parts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:]))
            assert sum(n for _, n in parts) == counts[length]
        assert sum(counts[k] for k in used) == len(lengths)
        for p in pieces:
            at = 0
            for offset, length in sorted(p):
                assert offset == at
                at += length
            assert 0 < at <= 4096
        bound = -(-int((counts * np.arange(4097)).sum()) // 4096)
        if slack is not None:
            assert bins <= bound * (1 + slack) + 1


def test_packing(docs, empty):
    rows = packing.pack(docs, capacity=64).collect()
    want = collections.Counter()
    for i, t, _, _ in ROWS:
        ids = reference_ids(t)
        for piece, a in enumerate(range(0, len(ids), 64)):
            part = np.array(ids[a:a + 64], dtype="<u4").tobytes()
            want[i, piece, a, len(part) // 4, zlib.crc32(part)] += 1
    assert bag((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    bins = collections.defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for p in bins.values():
        p.sort()
        assert p[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(p, p[1:])) and sum(p[-1]) <= 64
    assert packing.pack(empty).count() == 0


def test_numbering(spark):
    df = spark.range(5_000).select((F.col("id") % 3).alias("g"), F.col("id").alias("v"))
    rows = numbering.numbered(df, ["g"], F.xxhash64("v"), ["v"], 5_000, "n", 100).collect()
    for g in range(3):
        assert sorted(r.n for r in rows if r.g == g) == list(range(sum(1 for r in rows if r.g == g)))


@pytest.mark.parametrize("n", [1, 2, 3, 17, 1000, 4097])
def test_feistel_is_a_bijection(n):
    slots = training_order.slot_of(np.arange(n), n, 99)
    assert sorted(slots) == list(range(n))
    assert (training_order.number_of(slots, n, 99) == np.arange(n)).all()


def test_training_order_round_trip(docs, empty, tmp_path):
    out = f"file://{tmp_path}/shards"
    rows = training_order.materialise(docs, stride=32, shard_rows=40, out_dir=out).collect()
    assert sorted(r.slot for r in rows) == list(range(len(rows)))
    seqs = list(training_order.read_slots(out, 0, len(rows), 32, 40))
    assert len(seqs) == len(rows)
    got = sorted(rows, key=lambda r: r.slot)
    assert [zlib.crc32(s.tobytes()) for s in seqs] == [r.ids_crc32 for r in got]
    resumed = list(training_order.read_slots(out, 55, 30, 32, 40))
    assert all((a == b).all() for a, b in zip(resumed, seqs[55:85]))
    # laid end to end by number, the sequences hold every text's ids
    flat = np.concatenate([seqs[r.slot] for r in sorted(rows, key=lambda r: r.number)]).tolist()
    want = bag(tuple(reference_ids(t)) for _, t, _, _ in ROWS)
    assert len(flat) == sum(len(k) * n for k, n in want.items())
    # whole documents, one after the other: the end id may also occur inside a text
    def parsed(at, left):
        if at == len(flat):
            return not +left
        return any(parsed(at + len(k), left - bag([k])) for k in left if tuple(flat[at:at + len(k)]) == k)

    assert parsed(0, want)
    assert training_order.materialise(empty, out_dir=f"file://{tmp_path}/none").count() == 0

