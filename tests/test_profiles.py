"""Shape and invariant checks on character profiles, style prompts and CSV sources."""

import re

import pytest
from pyspark.sql import functions as F

from conftest import SF001
from scriptlens.plans import catalog
from scriptlens.session import new_table_path
from scriptlens.sources import adapters
from scriptlens.sources.dialogue import ingest_csv_sources, read_show_csv, write_csv_sources

TYPE = re.compile(r"^[EI][SN][TF][JP]$")


@pytest.fixture(scope="module")
def types(spark):
    return catalog.q_character_types(spark, SF001).collect()


def test_character_types_are_valid(types):
    assert types
    for r in types:
        assert TYPE.match(r.mbti)
        for d, pos in [("EI", "E"), ("SN", "S"), ("TF", "T"), ("JP", "J")]:
            p = r[f"p_{d}"]
            assert 0.0 <= p <= 1.0
            assert (p >= 0.5) == (r.mbti["EISNTFJP".index(pos) // 2] == pos)


def test_line_counts_agree(spark, types):
    counts = {(r.show_key, r.character.lower()): r.n_lines
              for r in catalog.q_character_line_counts(spark, SF001).collect()}
    for r in types:
        assert r.n_lines == counts[(r.show_key, r.character_key)]


def test_quotes_at_most_five_and_ordered(spark):
    rows = catalog.q_quote_scores(spark, SF001).collect()
    by_char = {}
    for r in rows:
        by_char.setdefault((r.show_key, r.character_key), []).append(r)
    for quotes in by_char.values():
        assert len(quotes) <= 5
        quotes.sort(key=lambda r: r.quote_rank)
        assert [q.quote_rank for q in quotes] == list(range(1, len(quotes) + 1))
        scores = [q.score for q in quotes]
        assert scores == sorted(scores, reverse=True)
        assert all(0.0 <= s <= 1.0 for s in scores)


def test_moments_first_in_file_order_with_total(spark):
    rows = catalog.q_character_moments(spark, SF001).collect()
    for r in rows:
        assert r.moment_rank <= 5 and r.total_matches >= r.moment_rank
        assert catalog.MOMENT_QUERY in r.full_dialogue.lower()
        # the context is cut at 240 characters, so the hit may lie past the
        # cut; every occurrence that is inside the snippet is highlighted
        plain = r.snippet.replace("\x1b[1;33m", "").replace("\x1b[0m", "")
        assert r.snippet.count("\x1b[1;33m") == plain.lower().count(catalog.MOMENT_QUERY)


def test_style_prompts_have_numbered_examples(spark):
    rows = catalog.q_style_prompts(spark, SF001).collect()
    for r in rows:
        assert r.prompt.startswith("\nRewrite the following sentence in the style of **" + r.character)
        assert f'Sentence: "{catalog.STYLE_SENTENCE}"' in r.prompt
        for i in range(1, r.n_examples + 1):
            assert f"\n{i}. " in r.prompt


def test_personalities_limited_per_show(spark):
    rows = catalog.q_show_personalities(spark, SF001).collect()
    per_show = {}
    for r in rows:
        per_show[r.show_key] = per_show.get(r.show_key, 0) + 1
        assert TYPE.match(r.mbti)
    assert all(n <= 2 for n in per_show.values())


def test_csv_ingest_skips_malformed_source(spark):
    lines = adapters.dialogue_lines(spark, SF001)
    root = write_csv_sources(spark, lines)
    bad = new_table_path(spark, "bad-source")
    spark.createDataFrame([("x", "y")], "season string, dialogue string").write.option("header", "true").csv(bad)
    from scriptlens.sources.dialogue import discover_sources
    sources = discover_sources(spark, root)
    sources["broken_show"] = bad
    got, skipped = ingest_csv_sources(spark, sources)
    assert got.count() == lines.count()
    reasons = {r.source: r.reason for r in skipped.collect()}
    assert list(reasons) == ["broken_show"] and "missing columns" in reasons["broken_show"]
    with pytest.raises(ValueError):
        read_show_csv(spark, bad, "broken_show")


def test_csv_ingest_keeps_quoted_line_breaks(spark):
    lines = adapters.dialogue_lines(spark, SF001)
    got, _ = ingest_csv_sources(spark, write_csv_sources(spark, lines))
    want = sorted(r.dialogue for r in lines.collect())
    assert sorted(r.dialogue for r in got.collect()) == want
    assert got.where(F.col("dialogue").contains("\n")).count() > 0


def test_words_past_the_500th_count(spark):
    from scriptlens.operators.profiles import character_types
    model = catalog.trait_model(spark, SF001)
    # terms of the vocabulary that pull one axis to either side
    pull = (model.logp.where("dim = 'EI'").groupBy("term").pivot("label", [0, 1]).agg(F.max("logp"))
            .select("term", (F.col("1") - F.col("0")).alias("d")).orderBy("d").collect())
    low, high = pull[0].term, pull[-1].term
    rows = [("s", 1, 1, "t", k, "Ann", " ".join([low if k < 60 else high] * 10)) for k in range(600)]
    lines = spark.createDataFrame(rows, "show_key string, season int, episode bigint, episode_title string, "
                                        "line_no bigint, character string, dialogue string")
    whole = character_types(lines, model).first()
    cut = character_types(lines, model, max_words=500).first()
    assert whole.n_lines == cut.n_lines == 600
    assert whole.p_EI > cut.p_EI


def test_line_context_over_gaps_and_null_keys(spark):
    from scriptlens.operators.documents import line_context
    rows = [("s", 1, 1, "a", 0, "x", "l0"), ("s", 1, 2, "b", 1, "y", "m0"), ("s", 1, 1, "a", 20_000, "z", "l1"),
            ("s", 1, 1, "a", 20_001, "x", "l2"), ("s", None, 1, "a", 5, "q", "n0"), ("s", None, 1, "a", 9, "q", "n1")]
    lines = spark.createDataFrame(rows, "show_key string, season int, episode bigint, episode_title string, "
                                        "line_no bigint, character string, dialogue string")
    got = {r.dialogue: (r.prev_dialogue, r.next_dialogue) for r in line_context(lines).collect()}
    assert got == {"l0": (None, "l1"), "l1": ("l0", "l2"), "l2": ("l1", None), "m0": (None, None),
                   "n0": (None, "n1"), "n1": ("n0", None)}


LINES = ("show_key string, season int, episode bigint, episode_title string, line_no bigint, character string, "
         "dialogue string")


def test_quotes_of_lines_that_share_a_number(spark):
    from scriptlens.operators.profiles import character_types, quote_scores
    model = catalog.trait_model(spark, SF001)
    terms = [r.term for r in model.vocab.orderBy("term").limit(40).collect()]
    texts = [" ".join(terms[k:k + 3]) for k in range(0, 36, 3)]
    # two episodes with the same numbers, and the last row three times
    rows = [("s", 0, k // 6, "t", k % 6, "Ann", text) for k, text in enumerate(texts)]
    rows += [rows[-1]] * 2
    apart = [(*r[:4], 10 * k, *r[5:]) for k, r in enumerate(rows)]
    met, alone = spark.createDataFrame(rows, LINES), spark.createDataFrame(apart, LINES)
    types = character_types(met, model)
    got = quote_scores(met, model, types, k=100).collect()
    want = quote_scores(alone, model, types, k=100).collect()
    place = lambda rs: sorted((r.episode, r.dialogue_raw, r.score) for r in rs)
    assert place(got) == place(want) and len(got) == len(rows)
    assert sorted(r.quote_rank for r in got) == list(range(1, len(rows) + 1))


def test_line_context_of_repeated_rows(spark):
    from scriptlens.operators.documents import line_context
    rows = [("s", 1, 1, "a", n, "x", d) for n, d in [(0, "l0"), (1, "l1"), (1, "l1"), (1, "m1"), (2, "l2")]]
    got = line_context(spark.createDataFrame(rows, LINES)).collect()
    assert sorted((r.prev_dialogue or "", r.dialogue, r.next_dialogue or "") for r in got) == [
        ("", "l0", "l1"), ("l0", "l1", "l1"), ("l1", "l1", "m1"), ("l1", "m1", "l2"), ("m1", "l2", "")]


def test_lines_of_two_files_are_numbered_by_file_name(spark, tmp_path):
    (tmp_path / "a.csv").write_text("season,episode,episode_title,character,dialogue\n1,1,t,c,first\n")
    (tmp_path / "b.csv").write_text("season,episode,episode_title,character,dialogue\n"
                                    + "".join(f'1,1,t,c,"b{k}\nmore"\n' for k in range(300)))
    rows = read_show_csv(spark, str(tmp_path), "s").orderBy("line_no").collect()
    assert [r.line_no for r in rows] == list(range(301))
    assert [r.dialogue for r in rows][:3] == ["first", "b0\nmore", "b1\nmore"]


def test_all_vectors_are_lines(spark):
    assert adapters.line_vectors(spark, SF001).count() == spark.read.parquet(f"{SF001}/embeddings.parquet").count()
    assert catalog.q_cosine_topk(spark, SF001).count() > 0
