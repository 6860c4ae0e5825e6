"""Trigram postings, versioned index, learned lemmas and quarantine against brute force."""

import random
import re

import pytest

from scriptlens.operators import lemmas as L
from scriptlens.operators import search as S
from scriptlens.operators import trigrams as G
from scriptlens.operators.index import DOC_KEYS, build_index, searchable_lines
from scriptlens.operators.versions import open_index, read_manifest
from scriptlens.plans import catalog
from scriptlens.session import new_table_path
from scriptlens.sources import adapters
from scriptlens.sources.dialogue import ingest_with_quarantine

LINES = "show_key string, season int, episode bigint, episode_title string, line_no bigint, character string, dialogue string"


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    words = ["coffee", "shop", "wedding", "central", "perk", "dinosaur", "break", "apt", "ouen", "ÄÖ", "🙂x", "the", "of"]
    rows = []
    for e in range(n):
        for k in range(rng.randrange(1, 6)):
            text = rng.choice([None, "", " ".join(rng.choices(words, k=rng.randrange(1, 12)))])
            rows.append((f"show{e % 3}", e % 4, e, rng.choice(["The Coffee", "Pilot", ""]) if k == 0 else None, e * 100 + k,
                         rng.choice(["Ross", "Monica", None]), text))
    titles = {r[2]: r[3] for r in rows if r[3] is not None}
    return [(s, a, e, titles[e], n_, c, t) for s, a, e, _, n_, c, t in rows]


QUERIES = ["coffee", "coffee shop", "coffee&shop", "wedding/dinosaur", "perk & central", "zzz", "fee sh", "o", "of", "&", "äö",
           "🙂x", "coffee/zzz", "zzz&coffee", "the coffee"]


def keys(df):
    return sorted(tuple(r) for r in df.select("query_id", *DOC_KEYS).collect())


@pytest.mark.parametrize("block_chars", [1, 200, 65_536])
def test_trigram_match_equals_the_scan(spark, block_chars):
    lines = searchable_lines(spark.createDataFrame(corpus(), LINES).repartition(4))
    prepared = S.prepare_queries(S.query_table(spark, QUERIES))
    index = G.build_trigrams(spark, lines, block_chars=block_chars)
    got = keys(G.matched_by_trigrams(index, prepared))
    assert got == keys(S.matched_documents(lines, prepared)) and len(got) > 100
    # brute force over joined texts
    docs = {}
    for s, a, e, t, n, _, text in sorted(corpus(), key=lambda r: r[4]):
        docs.setdefault((s, a, e, t), []).append((text or "").lower())
    want = []
    for q, query in enumerate(QUERIES):
        parts = [p.strip().lower() for p in query.replace("/", "&").split("&") if p.strip()] if "&" in query or "/" in query else [query.lower()]
        for doc, texts in docs.items():
            texts = [*texts[:-1], texts[-1] + " " + doc[3].lower()]
            hit = [any(p in t for t in texts) for p in parts]
            if (any(hit) if "/" in query else all(hit)):
                want.append((q, *doc))
    assert got == sorted(want)


def test_trigram_match_reads_candidate_blocks_only(spark):
    rows = [("s", 1, k, "T", k, "x", f"word{k:04d} filler filler") for k in range(400)]
    lines = searchable_lines(spark.createDataFrame(rows, LINES).repartition(2))
    index = G.build_trigrams(spark, lines, block_chars=100)
    assert index.texts.select("block").distinct().count() > 50
    parts = spark.createDataFrame([("word0123",)], "part string")
    candidates = G.candidate_blocks(index, parts)
    assert 0 < candidates.count() <= 20         # the numbers share trigrams, few blocks have all of them
    plan = G.part_documents(index, parts)._jdf.queryExecution().toString()
    assert re.search(r"PushedFilters: \[[^\]]*(In|EqualTo)\(block", plan)
    assert [r["episode"] for r in G.part_documents(index, parts).collect()] == [123]
    # a trigram that no text has rules the part out before any text is read
    assert G.candidate_blocks(index, spark.createDataFrame([("qqqword",)], "part string")).count() == 0


def test_a_batch_makes_no_row_for_a_block_and_part(spark):
    rows = [("s", 1, k, "T", k, "x", f"word{k:04d} filler filler") for k in range(400)]
    rows += [("s", 1, 7, "T", 1000 + k, "x", f"word{k:04d} again") for k in (8, 9)]
    index = G.build_trigrams(spark, searchable_lines(spark.createDataFrame(rows, LINES).repartition(2)), block_chars=100)
    asked = ["word0123", "filler", "word00", "zzzz", *[f"word{k:04d}" for k in range(100)]]
    chosen = G.rarest_grams(index, spark.createDataFrame([(p,) for p in asked], "part string")).collect()
    table = G.GramTable(chosen, asked)
    want = {(r["block"], asked.index(r["part"])) for r in G.candidate_blocks(
        index, spark.createDataFrame([(p,) for p in asked], "part string")).collect()}
    got = G.block_parts(index, table).collect()
    assert len(got) == len({b for b, _ in want}) == len({r["block"] for r in got})
    listed = {(r["block"], i) for r in got if r["asked"] is not None for i in r["asked"]}
    whole = {r["block"] for r in got if r["asked"] is None}
    assert listed == {(b, i) for b, i in want if b not in whole}
    assert all(sum(1 for b, _ in want if b == w) > G.LISTED_PARTS for w in whole)
    prepared = S.prepare_queries(S.query_table(spark, asked))
    docs = G.matched_by_trigrams(index, prepared)
    matched = sorted((r["query_id"], r["episode"]) for r in docs.collect())
    texts = {k: [f"word{k:04d} filler filler t"] for k in range(400)}
    texts[7] = ["word0007 filler filler", "word0008 again", "word0009 again t"]
    assert matched == sorted((q, k) for q, p in enumerate(asked) for k, held in texts.items() if any(p in t for t in held))
    assert [r["episode"] for r in index.several.collect()] == [7]


def test_documents_of_one_row_are_not_shuffled(spark):
    rows = [("s", 1, k, "T", k, "x", f"word{k:04d} filler") for k in range(40)]
    index = G.build_trigrams(spark, searchable_lines(spark.createDataFrame(rows, LINES)))
    docs = G.matched_by_trigrams(index, S.prepare_queries(S.query_table(spark, ["word0003", "filler&word001"])))
    assert "Exchange hashpartitioning" not in docs._jdf.queryExecution().executedPlan().toString()
    assert sorted((r["query_id"], r["episode"]) for r in docs.collect()) == [(0, 3), *[(1, k) for k in range(10, 20)]]


def test_finder_tells_the_parts_of_a_text():
    rng = random.Random(8)
    parts = ["".join(rng.choices("ab \u00e9\U0001f600", k=rng.randint(0, 14))) for _ in range(300)]
    table = S.PartTable([{"query_id": i, "qtype": "or", "n_parts": 1, "part_idx": 0, "part": p} for i, p in enumerate(parts)])
    find = table.finder()
    for n in (0, 1, 2, 3, 4, 7, 30, 400):
        text = "".join(rng.choices("ab \u00e9\U0001f600", k=n))
        assert sorted(find(text)) == [i for i, p in enumerate(table.parts) if p in text]


def test_many_parts_stay_a_table(spark, monkeypatch):
    lines = searchable_lines(spark.createDataFrame(corpus(3), LINES))
    prepared = S.prepare_queries(S.query_table(spark, QUERIES))
    want = keys(S.matched_documents(lines, prepared))
    monkeypatch.setattr(S, "PARTS_PER_PASS", 3)
    assert keys(S.matched_documents(lines, prepared)) == want


def test_search_with_trigrams_equals_search(spark):
    idx = build_index(spark.createDataFrame(corpus(5), LINES))
    grams = G.build_trigrams(spark, idx.lines)
    a = S.search(spark, idx, QUERIES, 3)
    idx.grams = grams
    b = S.search(spark, idx, QUERIES, 3)
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect())) and a.count()


# --- versions -----------------------------------------------------------------

def tables(index):
    names = {"postings": DOC_KEYS + ["term", "tf_body", "tf_title", "len_body", "len_title"], "doc_len": DOC_KEYS + ["len_body", "len_title"],
             "term_stats": ["show_key", "term", "df_body", "df_any"],
             "show_stats": ["show_key", "n_docs", "sum_len_body", "sum_len_title", "mean_idf_body", "mean_idf_any"]}
    return {name: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r)
                         for r in getattr(index, name).select(*cols).collect()) for name, cols in names.items()}


def test_changed_documents_become_a_segment(spark):
    path = new_table_path(spark, "versions")
    rows = corpus(7)
    first = spark.createDataFrame(rows, LINES)
    _, report = open_index(spark, path, first)
    assert report["version"] == 0 and not report["reused"]
    again, report = open_index(spark, path, first.repartition(5))
    assert report["reused"] and report["version"] == 0 and tables(again) == tables(build_index(first))

    changed = [r for r in rows if r[2] not in (4, 9)]                                      # two gone
    changed = [(*r[:6], (r[6] or "") + " dinosaur") if r[2] in (7, 12, 13) else r for r in changed]   # three changed
    changed += [("show9", 1, 900, "New", 1, "x", "brand new words"), ("show0", 1, 901, "Newer", 2, None, "coffee coffee")]
    second = spark.createDataFrame(changed, LINES)
    index, report = open_index(spark, path, second)
    assert report == {"version": 1, "reused": False, "added": 2, "changed": 3, "removed": 2}
    assert tables(index) == tables(build_index(second))
    assert index.doc_len.count() == read_manifest(spark, path)["n_episodes"]
    # only the changed documents were tokenised
    assert spark.read.parquet(f"{path}/v1/doc_len").count() == 5

    third = second.where("episode <> 900")          # a whole show goes
    index, report = open_index(spark, path, third)
    assert report == {"version": 2, "reused": False, "added": 0, "changed": 0, "removed": 1}
    assert tables(index) == tables(build_index(third))


def test_title_weight_and_many_segments_start_anew(spark, monkeypatch):
    path = new_table_path(spark, "versions")
    rows = corpus(11, 12)
    open_index(spark, path, spark.createDataFrame(rows, LINES), 2)
    index, report = open_index(spark, path, spark.createDataFrame(rows, LINES), 3)
    assert not report["reused"] and read_manifest(spark, path)["segments"] == [1]
    monkeypatch.setattr("scriptlens.operators.versions.MAX_SEGMENTS", 2)
    for k in range(2):
        rows = [*rows, ("show1", 1, 500 + k, "More", 500 + k, "x", f"more {k}")]
        index, _ = open_index(spark, path, spark.createDataFrame(rows, LINES), 3)
    assert read_manifest(spark, path)["segments"] == [3]        # a third segment: written as one
    assert tables(index) == tables(build_index(spark.createDataFrame(rows, LINES)))


def test_an_unfinished_version_is_not_read(spark):
    path = new_table_path(spark, "versions")
    lines = spark.createDataFrame(corpus(13, 10), LINES)
    open_index(spark, path, lines)
    lines.limit(3).write.parquet(f"{path}/v1/doc_len")      # a run that broke before its manifest
    index, report = open_index(spark, path, lines)
    assert report["reused"] and report["version"] == 0


def test_session_cache_does_not_outlive_the_files(spark, tmp_path):
    rows = [(1, "alpha beta", "en", "a", 10), (2, "gamma", "en", "a", 5)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    at = f"{tmp_path}/documents.parquet"
    spark.createDataFrame(rows, schema).write.parquet(at)
    before = adapters.table_version(spark, str(tmp_path), ("documents",))
    assert before == adapters.table_version(spark, str(tmp_path), ("documents",))
    assert catalog.corpus_index(spark, str(tmp_path), "documents").term_stats.count() == 3
    spark.createDataFrame([*rows, (3, "delta", "en", "a", 5)], schema).write.mode("overwrite").parquet(at)
    assert before != adapters.table_version(spark, str(tmp_path), ("documents",))
    assert catalog.corpus_index(spark, str(tmp_path), "documents").term_stats.count() == 4


# --- lemmas ----------------------------------------------------------------------

def test_learned_rules_and_lexicon(spark):
    stems = ["walk", "talk", "jump", "play", "look", "rain"]
    words = [s + e for s in stems for e in ("", "ing", "ed", "s")] + ["make", "making", "bake", "baking", "take", "taking", "wake",
                                                                     "waking", "rake", "raking", "sing", "ring", "red", "bus"]
    terms = spark.createDataFrame([(w,) for w in sorted(set(words))], "term string")
    rules = L.suffix_rules(terms, min_support=5)
    got = {(r["suffix"], r["ending"]): r["support"] for r in rules.collect()}
    assert got == {("ing", ""): 6, ("ed", ""): 6, ("s", ""): 6} | {k: v for k, v in got.items() if k[0] not in ("ing", "ed", "s")}
    lexicon = {r["term"]: r["lemma"] for r in L.learned_lexicon(terms, rules).collect()}
    assert lexicon["walking"] == "walk" and lexicon["played"] == "play" and lexicon["looks"] == "look"
    assert "sing" not in lexicon and "red" not in lexicon and "making" not in lexicon     # the best rule of -ing has no ending


def test_longest_suffix_wins_and_small_support_has_no_rule(spark):
    words = ["abcs", "abc", "abcess", "xyzs", "xyz", "xyzess", "pqrs", "pqr", "pqress"]
    terms = spark.createDataFrame([(w,) for w in words], "term string")
    rules = L.suffix_rules(terms, min_support=3)
    lexicon = {r["term"]: r["lemma"] for r in L.learned_lexicon(terms, rules).collect()}
    assert lexicon["abcess"] == "abc" and lexicon["abcs"] == "abc"
    assert L.suffix_rules(terms, min_support=4).count() == 0
    assert L.learned_lexicon(terms, L.suffix_rules(terms, min_support=4)).count() == 0


# --- quarantine --------------------------------------------------------------------

def test_rows_that_do_not_parse_are_put_aside(spark, tmp_path):
    (tmp_path / "a.csv").write_text(
        'season,episode,episode_title,character,dialogue\n'
        '1,1,Pilot,Ross,"Hello, ""you"""\n'
        'x,1,Pilot,Ross,wrong season\n'
        '1,two,Pilot,Ross,wrong episode\n'
        '1,1,Pilot\n'
        '1,1,Pilot,Ross,too,many,fields\n'
        '1,2,Next,Monica,"two\nlines"\n'
        '1,2,Next,"bro"ken" quotes,x\n')
    (tmp_path / "b.csv").write_text("season,episode\n1,1\n")
    lines, bad, skipped = ingest_with_quarantine(
        spark, {"a": f"{tmp_path}/a.csv", "b": f"{tmp_path}/b.csv", "c": f"{tmp_path}/none.csv"})
    good = [tuple(r) for r in lines.orderBy("line_no").select("line_no", "season", "episode", "dialogue").collect()]
    assert good[:2] == [(0, 1, 1, 'Hello, "you"'), (5, 1, 2, "two\nlines")]
    aside = {r["line_no"]: r["record"] for r in bad.collect()}
    assert {1, 2, 3, 4} <= set(aside) and aside[1] == "x,1,Pilot,Ross,wrong season" and aside[3] == "1,1,Pilot"
    assert len(good) + len(aside) == 7 and all(r["file"].endswith("a.csv") and r["show_key"] == "a" for r in bad.collect())
    assert sorted(r["source"] for r in skipped.collect()) == ["b", "c"]


def test_quarantine_of_clean_sources_is_empty(spark, tmp_path):
    (tmp_path / "a.csv").write_text("season,episode,episode_title,character,dialogue\n1,1,Pilot,Ross,Hi\n")
    lines, bad, skipped = ingest_with_quarantine(spark, {"a": f"{tmp_path}/a.csv"})
    assert lines.count() == 1 and bad.count() == 0 and skipped.count() == 0
    assert {"show_key", "season", "dialogue"} <= set(lines.columns)


def test_a_batch_makes_no_row_for_a_text_and_a_part(spark):
    """Up to ``PARTS_PER_PASS`` parts: texts meet no table of parts, and a document is
    shuffled once with the numbers of its parts."""
    rows = corpus(11)
    lines = searchable_lines(spark.createDataFrame(rows + rows[:40] + [
        ("s", 1, 900, None, 1, "x", "coffee shop"), ("s", 1, None, "T", 2, "x", "perk")], LINES))
    queries = spark.createDataFrame(
        [(k, q) for k, q in enumerate(QUERIES)] + [(0, "coffee"), (0, "wedding"), (None, "perk & central"), (2, "ouen/the/of"),
                                                   (30, "of&of&the"), (31, "coffee/wedding/perk")], "query_id bigint, query string")
    prepared = S.prepare_queries(queries)
    qp = S.match_parts(prepared)
    text = lines.select(*DOC_KEYS, S.searchable_text(lines).alias("_text"))
    # the plain way: every hit a row
    hits = S.shuffled_hits(text, DOC_KEYS, qp)
    names = ["query_id", "qtype", "n_parts", *DOC_KEYS]
    found = hits.select(*names, "part_idx").distinct().groupBy(*names).count().collect()
    want = sorted((tuple(r[c] for c in ["query_id", *DOC_KEYS]) for r in found
                   if (r["count"] == r["n_parts"] if r["qtype"] == "and" else True)), key=str)
    scan = S.matched_documents(lines, prepared)
    assert sorted(map(tuple, scan.collect()), key=str) == want and len(want) > 100
    assert sorted(map(tuple, G.matched_by_trigrams(G.build_trigrams(spark, lines, block_chars=200), prepared).collect()),
                  key=str) == want
    plan = scan._jdf.queryExecution().executedPlan().toString()
    before = [line for line in plan.splitlines() if "explode" in line.lower()]
    assert len([line for line in before if "_text" in line or "anchor" in line]) == 0
