"""DuckDB oracle SQL, one string per registered query (see ``catalog``).

The strings are generated from the same parameters the Spark queries use.
"""

from __future__ import annotations

from ..functions.wordlists import BM25_B, BM25_EPSILON, BM25_K1
from . import sqlgen as S

DOC_KEYS = "show_key, season, episode, episode_title"


def _docs_cte() -> str:
    """Episode documents the original way: ordered line concat, null keys dropped."""
    return """
    docs AS (
      SELECT show_key, season, episode, episode_title,
             string_agg(coalesce(dialogue, ''), chr(10) ORDER BY line_no) AS body
      FROM lines
      WHERE season IS NOT NULL AND episode IS NOT NULL AND episode_title IS NOT NULL
      GROUP BY show_key, season, episode, episode_title)"""


def bm25_ctes(title_weight: float, k1: float = BM25_K1, b: float = BM25_B,
              eps: float = BM25_EPSILON) -> str:
    w = max(int(title_weight), 0)
    combined = f"body || repeat(' ' || episode_title, {w})"
    return f"""
    toks AS (SELECT {DOC_KEYS}, {S.search_tokens(combined)} AS tok FROM docs),
    ncorp AS (SELECT show_key, count(*) AS n_docs, avg(len(tok)) AS avgdl FROM toks GROUP BY show_key),
    tfx AS (SELECT {DOC_KEYS}, len(tok) AS dl, unnest(tok) AS term FROM toks),
    tf AS (SELECT {DOC_KEYS}, term, any_value(dl) AS dl, count(*) AS tf FROM tfx GROUP BY {DOC_KEYS}, term),
    dfs AS (SELECT show_key, term, count(*) AS df FROM tf GROUP BY show_key, term),
    idf0 AS (SELECT d.show_key, d.term, ln(n.n_docs - d.df + 0.5) - ln(d.df + 0.5) AS idf_raw
             FROM dfs d JOIN ncorp n ON n.show_key = d.show_key),
    idfm AS (SELECT show_key, avg(idf_raw) AS mean_idf FROM idf0 GROUP BY show_key),
    idf AS (SELECT i.show_key, i.term,
                   CASE WHEN i.idf_raw < 0 THEN {eps} * m.mean_idf ELSE i.idf_raw END AS idf
            FROM idf0 i JOIN idfm m ON m.show_key = i.show_key)"""


def search_sql(lines_cte: str, queries, top_k: int, title_weight: float,
               k1: float = BM25_K1, b: float = BM25_B, overall: bool = False) -> str:
    """M2 per show (every show) for a list of queries; optionally with L2 rank."""
    raw = "lower(d.body || ' ' || d.episode_title)"
    overall_col = ""
    if overall:
        overall_col = (", CAST(row_number() OVER (PARTITION BY query_id ORDER BY relevance_score DESC, "
                       "show_key, season, episode, episode_title) AS BIGINT) AS overall_rank")
    return f"""
    WITH {lines_cte},
    {_docs_cte()},
    {bm25_ctes(title_weight, k1, b)},
    {S.values_queries(queries)},
    qp AS (SELECT query_id, query, {S.query_type('query')} AS qtype, {S.query_parts('query')} AS parts,
                  {S.display_parts('query')} AS dparts, {S.query_tokens('query')} AS qtokens FROM q),
    qt AS (SELECT query_id, unnest(qtokens) AS term FROM qp),
    scores AS (
      SELECT qt.query_id, tf.show_key, tf.season, tf.episode, tf.episode_title,
             sum(idf.idf * (tf.tf * {k1 + 1}) / (tf.tf + {k1} * ({1 - b} + {b} * tf.dl / n.avgdl))) AS bm25
      FROM qt JOIN tf ON tf.term = qt.term
              JOIN idf ON idf.show_key = tf.show_key AND idf.term = tf.term
              JOIN ncorp n ON n.show_key = tf.show_key
      GROUP BY qt.query_id, tf.show_key, tf.season, tf.episode, tf.episode_title),
    matched AS (
      SELECT qp.query_id, qp.query, qp.dparts, d.show_key, d.season, d.episode, d.episode_title, d.body
      FROM qp, docs d
      WHERE CASE WHEN qp.qtype = 'and' THEN {S.all_in(raw, 'qp.parts')} ELSE {S.any_in(raw, 'qp.parts')} END),
    ranked AS (
      SELECT m.*, round(CAST(coalesce(s.bm25, 0.0) + {S.title_hits('m.episode_title', 'm.dparts')} * {2.0 * float(title_weight)} AS DOUBLE), 6)
             AS relevance_score
      FROM matched m LEFT JOIN scores s
        ON s.query_id = m.query_id AND s.show_key = m.show_key AND s.season = m.season
       AND s.episode = m.episode AND s.episode_title = m.episode_title),
    top AS (
      SELECT *, row_number() OVER (PARTITION BY query_id, show_key
                                   ORDER BY relevance_score DESC, season, episode, episode_title) AS rank
      FROM ranked QUALIFY rank <= {top_k})
    SELECT query_id, query, show_key, season, episode, episode_title, relevance_score,
           {S.highlight(S.snippet('body', 'dparts'), 'dparts')} AS snippet_highlight,
           CAST(rank AS BIGINT) AS rank{overall_col}
    FROM top"""


# ---------------------------------------------------------------------------
# Everything else
# ---------------------------------------------------------------------------
def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes if c.strip())


def _title_queries_cte() -> str:
    return """
    titles AS (SELECT DISTINCT episode, episode_title FROM lines),
    q AS (
      SELECT CAST(episode * 3 + form AS BIGINT) AS query_id, query FROM (
        SELECT episode, 0 AS form, episode_title AS query FROM titles
        UNION ALL SELECT episode, 1, replace(episode_title, ' ', ' & ') FROM titles
        UNION ALL SELECT episode, 2, replace(episode_title, ' ', '/') FROM titles))"""


def _batch_queries_cte() -> str:
    """Title queries of the conversations whose id is divisible by 100."""
    cte = _title_queries_cte().strip().rstrip(",")
    return cte.replace("q AS (", "q AS (SELECT * FROM (", 1) + " WHERE query_id % 300 < 3)"


def _matched_sql(lines_cte: str, q_cte: str) -> str:
    raw = "lower(d.body || ' ' || d.episode_title)"
    return f"""{_with(lines_cte, _docs_cte(), q_cte,
        f"qp AS (SELECT query_id, {S.query_type('query')} AS qtype, {S.query_parts('query')} AS parts FROM q)")}
    SELECT qp.query_id, d.show_key, d.episode
    FROM qp, docs d
    WHERE CASE WHEN qp.qtype = 'and' THEN {S.all_in(raw, 'qp.parts')} ELSE {S.any_in(raw, 'qp.parts')} END"""


def _posts_texts(flavour: str) -> str:
    fn = S.normalize_baseline if flavour == "baseline" else S.normalize_classifier
    return f"texts AS (SELECT row_id, {fn('posts', True)} AS text FROM posts)"


def _long_labels() -> str:
    sel = []
    for i, (dim, pos, neg) in enumerate([("EI", "E", "I"), ("SN", "S", "N"), ("TF", "T", "F"), ("JP", "J", "P")]):
        ch = f"substr(upper(type), {i + 1}, 1)"
        sel.append(f"SELECT row_id, '{dim}' AS dim, CASE WHEN {ch} = '{pos}' THEN 1 WHEN {ch} = '{neg}' THEN 0 END AS label FROM posts")
    return "lab AS (SELECT * FROM (" + " UNION ALL ".join(sel) + ") WHERE label IS NOT NULL)"


def _tfidf_ctes(fit_rows: str = "SELECT row_id FROM posts") -> str:
    return f"""
    fit_rows AS ({fit_rows}),
    vtoks AS (SELECT row_id, unnest({S.vectorizer_tokens('text')}) AS term FROM texts),
    counts AS (SELECT row_id, term, count(*) AS cnt FROM vtoks GROUP BY row_id, term),
    vstats AS (SELECT term, sum(cnt) AS cf, count(*) AS df FROM counts WHERE row_id IN (SELECT row_id FROM fit_rows) GROUP BY term),
    vocab AS (SELECT term, ln((1.0 + (SELECT count(*) FROM fit_rows)) / (1.0 + df)) + 1.0 AS idf
              FROM vstats ORDER BY cf DESC, term LIMIT 1500),
    xw AS (SELECT c.row_id, c.term, c.cnt * v.idf AS x0 FROM counts c JOIN vocab v ON v.term = c.term),
    xf AS (SELECT row_id, term, x0 / sqrt(sum(x0 * x0) OVER (PARTITION BY row_id)) AS x FROM xw)"""


def _nb_fit_ctes(train_lab: str, model: str = "", alpha: float = 1.0) -> str:
    """NB tables from ``train_lab`` (row_id, dim, label[, model_fold])."""
    mk = f"{model}, " if model else ""
    mj = f" AND a.{model} = b.{model}" if model else ""
    part = f"PARTITION BY {model}, dim" if model else "PARTITION BY dim"
    return f"""
    tl AS ({train_lab}),
    cls AS (SELECT {mk}dim, label, count(*) AS n_c FROM tl GROUP BY ALL),
    prior AS (SELECT {mk}dim, label, ln(n_c / sum(n_c) OVER ({part})) AS prior FROM cls),
    sums AS (SELECT {('tl.' + model + ', ') if model else ''}tl.dim, tl.label, xf.term, sum(xf.x) AS fs
             FROM xf JOIN tl ON tl.row_id = xf.row_id GROUP BY ALL),
    grid AS (SELECT c.*, v.term FROM cls c, vocab v),
    filled AS (SELECT a.{mk.replace(', ', '') + ', a.' if model else ''}dim, a.label, a.term, coalesce(b.fs, 0.0) AS fs
               FROM grid a LEFT JOIN sums b ON a.dim = b.dim AND a.label = b.label AND a.term = b.term{mj}),
    tot AS (SELECT {mk}dim, label, sum(fs) AS tot FROM filled GROUP BY ALL),
    logp AS (SELECT a.{mk.replace(', ', '') + ', a.' if model else ''}dim, a.label, a.term,
                    ln(a.fs + {alpha}) - ln(b.tot + {alpha} * (SELECT count(*) FROM vocab)) AS logp
             FROM filled a JOIN tot b ON a.dim = b.dim AND a.label = b.label{mj})"""


def _nb_pred_ctes(rows: str, feats: str = "xf") -> str:
    """p1 / pred per (id, dim) for ``rows`` (id) against tables logp / prior."""
    return f"""
    srows AS ({rows}),
    dotp AS (SELECT f.id, lp.dim, lp.label, sum(f.x * lp.logp) AS dot
             FROM {feats} f JOIN logp lp ON lp.term = f.term WHERE f.id IN (SELECT id FROM srows) GROUP BY ALL),
    jll AS (SELECT r.id, p.dim, p.label, p.prior + coalesce(d.dot, 0.0) AS jll
            FROM srows r CROSS JOIN prior p LEFT JOIN dotp d ON d.id = r.id AND d.dim = p.dim AND d.label = p.label),
    pj AS (SELECT id, dim, max(jll) FILTER (WHERE label = 0) AS j0, max(jll) FILTER (WHERE label = 1) AS j1
           FROM jll GROUP BY id, dim),
    pred AS (SELECT id, dim,
                    CASE WHEN j0 IS NULL THEN 1.0 WHEN j1 IS NULL THEN 0.0 ELSE 1.0 / (1.0 + exp(j0 - j1)) END AS p1,
                    CASE WHEN j0 IS NULL THEN 1 WHEN j1 IS NULL THEN 0 WHEN j1 > j0 THEN 1 ELSE 0 END AS pred
             FROM pj)"""


def _wide(pred: str, id_col: str = "id") -> str:
    cols = ", ".join(f"max(p1) FILTER (WHERE dim = '{d}') AS p_{d}" for d in ["EI", "SN", "TF", "JP"])
    letters = " || ".join(
        f"(CASE WHEN max(p1) FILTER (WHERE dim = '{d}') >= 0.5 THEN '{p}' ELSE '{n}' END)"
        for d, p, n in [("EI", "E", "I"), ("SN", "S", "N"), ("TF", "T", "F"), ("JP", "J", "P")])
    return f"SELECT {id_col}, {cols}, {letters} AS mbti FROM {pred} GROUP BY {id_col}"


def _split_cte() -> str:
    return """
    spl AS (
      SELECT row_id, type, row_number() OVER (PARTITION BY type ORDER BY md5('42:' || CAST(row_id AS VARCHAR)), row_id) - 1 AS r,
             count(*) OVER (PARTITION BY type) AS n FROM posts),
    split AS (
      SELECT row_id, type, CASE WHEN r < floor(n * 0.2 + 0.5) THEN 'test'
                                WHEN r < floor(n * 0.2 + 0.5) + floor((n - floor(n * 0.2 + 0.5)) * 0.125 + 0.5) THEN 'val'
                                ELSE 'train' END AS split
      FROM spl)"""


def _model_ctes() -> list[str]:
    """The trait model: classifier-flavour TF-IDF and NB fitted on train rows."""
    return [S.posts_cte(), _split_cte(), _posts_texts("classifier"), _long_labels(),
            _tfidf_ctes("SELECT row_id FROM split WHERE split = 'train'"),
            _nb_fit_ctes("SELECT lab.* FROM lab JOIN split USING (row_id) WHERE split = 'train'")]


def _head_ctes(rate: float, epochs: int, patience: int) -> list[str]:
    """The logistic heads by unrolled gradient steps: weights w0 ... wE, losses per
    epoch, the epochs run before patience ends, and the chosen one."""
    ctes = [S.posts_cte(), _split_cte(), _posts_texts("classifier"), _long_labels(),
            _tfidf_ctes("SELECT row_id FROM split WHERE split = 'train'"),
            """feat AS MATERIALIZED (SELECT row_id, term, x FROM xf UNION ALL SELECT row_id, '' AS term, 1.0 AS x FROM posts),
    hl AS MATERIALIZED (SELECT lab.row_id, dim, label, split FROM lab JOIN split USING (row_id)),
    nt AS (SELECT dim, count(*) AS n FROM hl WHERE split = 'train' GROUP BY dim),
    w0 AS (SELECT d.dim, t.term, CAST(0.0 AS DOUBLE) AS w FROM (SELECT DISTINCT dim FROM hl) d,
           (SELECT term FROM vocab UNION ALL SELECT '') t)"""]
    loss = []
    for e in range(1, epochs + 1):
        ctes.append(f"""z{e} AS MATERIALIZED (SELECT hl.row_id, hl.dim, hl.label, hl.split, sum(f.x * w.w) AS z
           FROM hl JOIN feat f ON f.row_id = hl.row_id JOIN w{e - 1} w ON w.dim = hl.dim AND w.term = f.term GROUP BY ALL),
    g{e} AS (SELECT z.dim, f.term, sum((1.0 / (1.0 + exp(-z.z)) - z.label) * f.x) AS g
           FROM z{e} z JOIN feat f ON f.row_id = z.row_id WHERE z.split = 'train' GROUP BY ALL),
    w{e} AS MATERIALIZED (SELECT w.dim, w.term, w.w - {rate} * coalesce(g.g, 0.0) / nt.n AS w
           FROM w{e - 1} w JOIN nt ON nt.dim = w.dim LEFT JOIN g{e} g ON g.dim = w.dim AND g.term = w.term)""")
        loss.append(f"""SELECT {e} AS epoch, hl.dim, hl.split, hl.row_id, hl.label, sum(f.x * w.w) AS z
           FROM hl JOIN feat f ON f.row_id = hl.row_id JOIN w{e} w ON w.dim = hl.dim AND w.term = f.term
           WHERE hl.split <> 'test' GROUP BY ALL""")
    ctes.append(f"""el AS MATERIALIZED (
      SELECT epoch, dim,
             avg(greatest(z, 0) + ln(1.0 + exp(-abs(z))) - label * z) FILTER (WHERE split = 'train') AS train_loss,
             avg(greatest(z, 0) + ln(1.0 + exp(-abs(z))) - label * z) FILTER (WHERE split = 'val') AS val_loss
      FROM ({' UNION ALL '.join(loss)}) GROUP BY epoch, dim),
    em AS (SELECT epoch, avg(val_loss) AS m FROM el GROUP BY epoch),
    eb AS (SELECT epoch, m, coalesce(m < min(m) OVER (ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS better FROM em),
    ew AS (SELECT epoch, epoch - max(CASE WHEN better THEN epoch END) OVER (ORDER BY epoch) AS waited, better FROM eb),
    ek AS (SELECT epoch, better FROM ew WHERE epoch <= coalesce((SELECT min(epoch) FROM ew WHERE waited >= {patience}), {epochs})),
    chosen AS (SELECT max(epoch) AS epoch FROM ek WHERE better),
    heads AS (SELECT * FROM ({' UNION ALL '.join(f"SELECT {e} AS epoch, dim, term, w FROM w{e}" for e in range(1, epochs + 1))})
              WHERE epoch = (SELECT epoch FROM chosen))""")
    return ctes


def _head_pred_ctes(rows: str, feats: str) -> str:
    """p1 per (id, dim) of the kept heads; ``feats`` are (id, term, x)."""
    return f"""
    hdot AS (SELECT f.id, h.dim, sum(f.x * h.w) AS z FROM {feats} f JOIN heads h ON h.term = f.term GROUP BY ALL),
    pred AS (SELECT r.id, b.dim, 1.0 / (1.0 + exp(-(coalesce(d.z, 0.0) + b.w))) AS p1
             FROM ({rows}) r CROSS JOIN (SELECT dim, w FROM heads WHERE term = '') b
             LEFT JOIN hdot d ON d.id = r.id AND d.dim = b.dim)"""


def _char_texts_ctes() -> str:
    clean = S.normalize_classifier("dialogue")
    return f"""
    cl AS (SELECT show_key, lower(character) AS character_key, line_no, {clean} AS clean
           FROM lines WHERE character IS NOT NULL),
    cn AS (SELECT show_key, character_key, count(*) AS n_lines FROM cl GROUP BY ALL),
    cj AS (SELECT show_key, character_key, string_agg(clean, ' ' ORDER BY line_no) AS allt
           FROM cl WHERE clean <> '' GROUP BY ALL),
    ctext AS (SELECT cn.show_key, cn.character_key, cn.n_lines,
                     coalesce({S.strip('cj.allt')}, '') AS text
              FROM cn LEFT JOIN cj ON cj.show_key = cn.show_key AND cj.character_key = cn.character_key)"""


def _score_texts_ctes(prefix: str, texts: str) -> str:
    """TF-IDF of (id, text) with the model vocabulary, then NB p1 per axis."""
    return f"""
    {prefix}t AS ({texts}),
    {prefix}tok AS (SELECT id, unnest({S.vectorizer_tokens('text')}) AS term FROM {prefix}t),
    {prefix}cnt AS (SELECT id, term, count(*) AS cnt FROM {prefix}tok GROUP BY ALL),
    {prefix}xw AS (SELECT c.id, c.term, c.cnt * v.idf AS x0 FROM {prefix}cnt c JOIN vocab v ON v.term = c.term),
    {prefix}xf AS (SELECT id, term, x0 / sqrt(sum(x0 * x0) OVER (PARTITION BY id)) AS x FROM {prefix}xw),
    {_nb_pred_ctes(f"SELECT id FROM {prefix}t", f"{prefix}xf").strip().replace('srows', prefix + 'rows').replace('dotp', prefix + 'dot').replace('jll', prefix + 'jll').replace('pj', prefix + 'pj').replace('pred AS', prefix + 'pred AS')}"""


def _char_types_ctes() -> list[str]:
    texts = "SELECT show_key || chr(1) || character_key AS id, text FROM ctext WHERE text <> ''"
    return [*_model_ctes(), _char_texts_ctes(), _score_texts_ctes("c", texts),
            f"cw AS ({_wide('cpred')})",
            f"""ctypes AS (SELECT t.show_key, t.character_key, t.n_lines,
                   round(w.p_EI, 6) AS p_EI, round(w.p_SN, 6) AS p_SN, round(w.p_TF, 6) AS p_TF,
                   round(w.p_JP, 6) AS p_JP, w.mbti
               FROM ctext t JOIN cw w ON w.id = t.show_key || chr(1) || t.character_key WHERE t.text <> '')"""]


def _style_ctes() -> list[str]:
    return [S.line_vectors_cte(), """
    elig AS (SELECT character, CAST(count(*) AS BIGINT) AS n_lines FROM line_vecs
             WHERE character IS NOT NULL AND dialogue IS NOT NULL AND length(character) >= 3 AND length(dialogue) > 5
             GROUP BY character HAVING count(*) >= 45),
    corpus AS (SELECT v.* FROM line_vecs v WHERE v.dialogue IS NOT NULL AND length(v.dialogue) > 5
               AND v.character IN (SELECT character FROM elig)),
    comps AS (SELECT character, pos, avg(CAST(val AS DOUBLE)) AS m
              FROM (SELECT character, unnest(embedding) AS val, generate_subscripts(embedding, 1) AS pos FROM corpus)
              GROUP BY character, pos),
    req AS (SELECT character, list(m ORDER BY pos) AS rv FROM comps GROUP BY character),
    pairs AS (
      SELECT c.character AS request_id, c.character, c.line_id, c.dialogue,
             round(list_dot_product(list_transform(c.embedding, lambda z: CAST(z AS DOUBLE)), r.rv)
                   / (sqrt(list_dot_product(list_transform(c.embedding, lambda z: CAST(z AS DOUBLE)),
                                            list_transform(c.embedding, lambda z: CAST(z AS DOUBLE))))
                      * sqrt(list_dot_product(r.rv, r.rv))), 6) AS cosine
      FROM corpus c JOIN req r ON r.character = c.character),
    near AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY cosine DESC, line_id) AS example_rank
             FROM pairs QUALIFY example_rank <= 5)"""]


def all_sql() -> dict[str, str]:
    from ..functions.wordlists import DEFAULT_TITLE_WEIGHT as TW
    from ..functions.wordlists import DEFAULT_TOP_K as K
    from . import catalog as CT

    dl, dc = S.dialogue_lines_cte(), S.document_lines_cte()
    out: dict[str, str] = {}

    out["show_registry"] = f"""{_with(dl)}
    SELECT show_key, coalesce(CASE show_key {' '.join(f"WHEN {S.lit(k)} THEN {S.lit(v)}" for k, v in __import__('scriptlens.functions.wordlists', fromlist=['x']).SHOW_NAMES.items())} END, show_key) AS show_name,
           CAST(count(DISTINCT (season, episode, episode_title)) AS BIGINT) AS n_episodes,
           CAST(count(*) AS BIGINT) AS n_lines, CAST(count(DISTINCT character) AS BIGINT) AS n_characters
    FROM lines GROUP BY show_key"""

    from ..functions.wordlists import SHOW_ALIASES, SHOW_NAMES
    alias_case = " ".join(f"WHEN {S.lit(k)} THEN {S.lit(v)}" for k, v in SHOW_ALIASES.items())
    name_case = " ".join(f"WHEN {S.lit(k)} THEN {S.lit(v)}" for k, v in SHOW_NAMES.items())
    out["alias_resolution"] = f"""{_with(dl, f"typed AS (SELECT DISTINCT '  ' || upper(unnest([list_extract([{', '.join(S.lit(a) for a in SHOW_ALIASES)}], episode % {len(SHOW_ALIASES)} + 1), show_key])) || ' ' AS typed FROM lines)")}
    SELECT typed, CASE lower({S.strip('typed')}) {alias_case} END AS resolved_key,
           coalesce(CASE coalesce(CASE lower({S.strip('typed')}) {alias_case} END, lower(trim(typed))) {name_case} END,
                    coalesce(CASE lower({S.strip('typed')}) {alias_case} END, lower(trim(typed)))) AS show_name
    FROM typed"""

    out["distinct_counts"] = f"""{_with(dl)},
    things AS (SELECT show_key, 'characters' AS thing, character AS value FROM lines
               UNION ALL SELECT show_key, 'episodes', concat_ws('/', season, episode, episode_title) FROM lines
               UNION ALL SELECT show_key, 'words', unnest({S.search_tokens('dialogue')}) FROM lines)
    SELECT show_key, thing, CAST(count(DISTINCT value) AS BIGINT) AS exact, true AS in_bound
    FROM things WHERE value IS NOT NULL GROUP BY show_key, thing"""
    out["episode_documents"] = f"""{_with(dl, _docs_cte())},
    n AS (SELECT show_key, season, episode, episode_title, CAST(count(*) AS BIGINT) AS n_lines FROM lines
          WHERE season IS NOT NULL AND episode IS NOT NULL AND episode_title IS NOT NULL GROUP BY ALL)
    SELECT d.show_key, d.season, d.episode, d.episode_title, d.body AS dialogue, n.n_lines, d.body AS dialogue_raw
    FROM docs d JOIN n USING (show_key, season, episode, episode_title)"""

    out["union_sources"] = f"""{_with(dl)}
    SELECT show_key, season, episode, episode_title,
           CAST(row_number() OVER (PARTITION BY show_key ORDER BY line_no) - 1 AS BIGINT) AS line_no,
           character, dialogue FROM lines"""

    out["quarantined_lines"] = f"""{_with(dl)},
    n AS (SELECT show_key, CAST(row_number() OVER (PARTITION BY show_key ORDER BY line_no) - 1 AS BIGINT) AS line_no,
                 season, episode, dialogue, episode % 3 <> 1 AS parsed FROM lines)
    SELECT show_key, line_no, CASE WHEN parsed THEN season END AS season, CASE WHEN parsed THEN episode END AS episode,
           CASE WHEN parsed THEN dialogue END AS dialogue, parsed FROM n"""
    out["streamed_lines"] = f"""{_with(dl)}
    SELECT show_key, season, episode, episode_title, line_no, character, dialogue FROM lines"""

    out["index_roundtrip"] = f"""{_with(dc, _docs_cte(), bm25_ctes(TW))},
    sep AS (SELECT {DOC_KEYS}, unnest({S.search_tokens('body')}) AS term, 1 AS b, 0 AS t FROM docs
            UNION ALL SELECT {DOC_KEYS}, unnest({S.search_tokens('episode_title')}), 0, 1 FROM docs),
    post AS (SELECT {DOC_KEYS}, term, sum(b) AS tfb, sum(t) AS tft FROM sep GROUP BY ALL)
    SELECT show_key, CAST(count(*) AS BIGINT) AS n_postings, CAST(sum(tfb) AS BIGINT) AS sum_tf_body,
           CAST(sum(tft) AS BIGINT) AS sum_tf_title, CAST(count(DISTINCT term) AS BIGINT) AS n_terms
    FROM post GROUP BY show_key"""

    out["line_context"] = f"""{_with(dl)}
    SELECT show_key, season, episode, episode_title, line_no * 3 AS line_no, character, dialogue,
           lag(character) OVER doc AS prev_character, lag(dialogue) OVER doc AS prev_dialogue,
           lead(character) OVER doc AS next_character, lead(dialogue) OVER doc AS next_dialogue
    FROM lines WINDOW doc AS (PARTITION BY show_key, season, episode, episode_title ORDER BY line_no)"""

    counts = "SELECT show_key, character, CAST(count(*) AS BIGINT) AS n_lines FROM lines WHERE character IS NOT NULL GROUP BY ALL"
    out["character_line_counts"] = f"{_with(dl)} {counts}"
    out["top_characters"] = f"""{_with(dl, f"c AS ({counts})")}
    SELECT show_key, character, n_lines, row_number() OVER (PARTITION BY show_key ORDER BY n_lines DESC, character) AS count_rank
    FROM c QUALIFY count_rank <= 2"""
    out["first_characters"] = f"""{_with(dl)}
    SELECT show_key, character, min(line_no) AS first_line_no,
           row_number() OVER (PARTITION BY show_key ORDER BY min(line_no), character) AS appearance_rank
    FROM lines WHERE character IS NOT NULL GROUP BY show_key, character QUALIFY appearance_rank <= 2"""
    out["eligible_characters"] = f"{_with(*_style_ctes())} SELECT character, n_lines FROM elig"
    out["character_documents"] = f"{_with(dl, _char_texts_ctes())} SELECT * FROM ctext"

    out["character_terms"] = f"""{_with(dl)}
    SELECT show_key, character_key, term, CAST(count(*) AS BIGINT) AS cnt
    FROM (SELECT show_key, lower(character) AS character_key, unnest({S.vectorizer_tokens(S.normalize_classifier('dialogue'))}) AS term
          FROM lines WHERE character IS NOT NULL) GROUP BY ALL"""

    out["normalize_search"] = f"SELECT doc_id, {S.normalize_search('text')} AS text FROM documents"
    out["tokenize_search"] = f"SELECT doc_id, {S.search_tokens('text')} AS tokens FROM documents"
    out["tokenize_lemmas"] = f"""SELECT doc_id, list_transform({S.search_tokens('text')},
           lambda t: CASE WHEN regexp_matches(t, '^.{{3,}}ing$') THEN substr(t, 1, length(t) - 3) ELSE t END) AS tokens
    FROM documents"""
    from ..operators import lemmas as L

    cuts = f"""
    terms AS (SELECT DISTINCT unnest({S.search_tokens('text')}) AS term FROM documents),
    cuts AS (SELECT term, substr(term, 1, length(term) - n) AS stem, substr(term, length(term) - n + 1) AS suffix
             FROM terms, unnest(range(1, least({L.MAX_SUFFIX}, length(term) - {L.MIN_STEM}) + 1)) AS u(n)),
    led AS (SELECT c.term, c.suffix, e.ending, c.stem || e.ending AS lemma
            FROM cuts c, (VALUES {', '.join(f"({S.lit(e)})" for e in L.ENDINGS)}) AS e(ending)
            WHERE c.suffix <> e.ending AND c.stem || e.ending IN (SELECT term FROM terms)),
    counts AS (SELECT suffix, ending, count(*) AS support FROM led WHERE length(suffix) > length(ending)
               GROUP BY ALL HAVING count(*) >= {L.MIN_SUPPORT}),
    rules AS (SELECT suffix, ending, CAST(support AS BIGINT) AS support FROM
              (SELECT *, row_number() OVER (PARTITION BY suffix ORDER BY support DESC, ending) AS r FROM counts)
              WHERE r = 1 ORDER BY support DESC, suffix LIMIT {L.MAX_RULES})"""
    out["suffix_rules"] = f"{_with(cuts)} SELECT * FROM rules"
    out["learned_lemmas"] = f"""{_with(cuts)},
    lex AS (SELECT term, arg_max(lemma, length(suffix)) AS lemma FROM led JOIN rules USING (suffix, ending) GROUP BY term),
    tok AS (SELECT doc_id, {S.search_tokens('text')} AS tokens FROM documents),
    flat AS (SELECT doc_id, i, tokens[i] AS term FROM tok, unnest(range(1, len(tokens) + 1)) AS u(i)),
    done AS (SELECT doc_id, list(coalesce(lex.lemma, flat.term) ORDER BY i) AS tokens FROM flat LEFT JOIN lex USING (term) GROUP BY doc_id)
    SELECT tok.doc_id, coalesce(done.tokens, []) AS tokens FROM tok LEFT JOIN done USING (doc_id)"""
    out["show_extremes"] = f"""{_with(dl, "n AS (SELECT show_key, count(*) AS n FROM lines GROUP BY show_key)")}
    SELECT CAST(count(*) AS BIGINT) AS n_shows, (SELECT show_key FROM n ORDER BY n.n DESC, show_key LIMIT 1) AS largest_show FROM n"""
    mk = f"({S.lit(CT.MARKED_HEAD)} || coalesce(text, '') || {S.lit(CT.MARKED_TAIL)})"
    out["normalize_marked"] = f"""SELECT doc_id, {S.normalize_search(mk)} AS search, {S.search_tokens(mk)} AS tokens,
           {S.normalize_classifier(mk, True)} AS classifier, {S.normalize_baseline(mk, True)} AS baseline FROM documents"""
    out["normalize_classifier"] = f"{_with(S.posts_cte())} SELECT row_id, {S.normalize_classifier('posts', True)} AS text FROM posts"
    out["normalize_baseline"] = f"{_with(S.posts_cte())} SELECT row_id, {S.normalize_baseline('posts', True)} AS text FROM posts"

    out["query_parse"] = f"""{_with(dl, _title_queries_cte())}
    SELECT query_id, query, {S.query_type('query')} AS qtype, {S.query_parts('query')} AS parts,
           {S.display_parts('query')} AS display_parts FROM q"""
    out["match_phrase"] = _matched_sql(dc, S.values_queries(["Ertion"]))
    out["match_and"] = _matched_sql(dc, S.values_queries(["erth&ouen"]))
    out["match_or"] = _matched_sql(dc, S.values_queries(["thth/ouen"]))
    out["match_batch"] = _matched_sql(dc + ",\n" + dl.replace("lines AS (", "dlines AS (").replace("first_turn", "ft2"),
                                      _batch_queries_cte().replace("FROM lines", "FROM dlines"))

    out["match_indexed"] = out["match_batch"]
    out["match_indexed_and"] = out["match_and"]

    sep = f"""sep AS (SELECT {DOC_KEYS}, unnest({S.search_tokens('body')}) AS term, 1 AS b, 0 AS t FROM docs
            UNION ALL SELECT {DOC_KEYS}, unnest({S.search_tokens('episode_title')}), 0, 1 FROM docs),
    post AS (SELECT {DOC_KEYS}, term, CAST(sum(b) AS BIGINT) AS tf_body, CAST(sum(t) AS BIGINT) AS tf_title FROM sep GROUP BY ALL)"""
    out["term_stats"] = f"""{_with(dc, _docs_cte(), sep)}
    SELECT show_key, term, CAST(count(*) FILTER (WHERE tf_body > 0) AS BIGINT) AS df_body, CAST(count(*) AS BIGINT) AS df_any
    FROM post GROUP BY show_key, term"""
    out["versioned_term_stats"] = out["term_stats"]
    out["doc_lengths"] = f"""{_with(dc, _docs_cte())}
    SELECT show_key, episode, CAST(len({S.search_tokens('body')}) AS BIGINT) AS len_body,
           CAST(len({S.search_tokens('episode_title')}) AS BIGINT) AS len_title FROM docs"""
    out["postings_top"] = f"""{_with(dc, _docs_cte(), sep)}
    SELECT show_key, episode, term, tf_body,
           row_number() OVER (PARTITION BY show_key, episode ORDER BY tf_body DESC, term) AS term_rank
    FROM post QUALIFY term_rank <= 3"""

    out["bm25_scores"] = f"""{_with(dc, _docs_cte(), bm25_ctes(TW), S.values_queries(CT.DOC_QUERIES))},
    qt AS (SELECT query_id, unnest({S.query_tokens('query')}) AS term FROM q)
    SELECT qt.query_id, tf.show_key, tf.episode,
           round(sum(idf.idf * (tf.tf * {BM25_K1 + 1}) / (tf.tf + {BM25_K1} * ({1 - BM25_B} + {BM25_B} * tf.dl / n.avgdl))), 6) AS bm25
    FROM qt JOIN tf ON tf.term = qt.term JOIN idf ON idf.show_key = tf.show_key AND idf.term = tf.term
         JOIN ncorp n ON n.show_key = tf.show_key
    GROUP BY qt.query_id, tf.show_key, tf.season, tf.episode, tf.episode_title"""

    out["search_episodes"] = search_sql(dc, CT.DOC_QUERIES, K, TW)
    out["search_all_shows"] = search_sql(dl, CT.DIALOGUE_QUERIES, K, TW, overall=True)
    out["search_one_show"] = f"SELECT * FROM ({search_sql(dl, CT.DIALOGUE_QUERIES, 3, TW)}) WHERE show_key = 'show1'"
    out["search_title_weight0"] = search_sql(dl, CT.DIALOGUE_QUERIES, 3, 0)
    bq = search_sql(dl, ["x"], 3, TW)
    bq = bq.replace(S.values_queries(["x"]), _batch_queries_cte().strip().rstrip(","))
    out["search_batch"] = bq
    out["search_indexed"] = bq
    out["versioned_search"] = out["search_episodes"]
    out["search_pruned"] = out["search_episodes"]

    parts = S.display_parts(S.lit(CT.SNIPPET_QUERY))
    out["snippets"] = f"""{_with(dl, _docs_cte())}
    SELECT show_key, season, episode, episode_title, {S.snippet('body', parts)} AS snippet,
           {S.highlight(S.snippet('body', parts), parts)} AS highlighted FROM docs"""

    enc = ", ".join(
        f"CAST(CASE WHEN substr(upper(type), {i + 1}, 1) = '{p}' THEN 1 WHEN substr(upper(type), {i + 1}, 1) = '{n}' THEN 0 END AS INTEGER) AS {d}"
        for i, (d, p, n) in enumerate([("EI", "E", "I"), ("SN", "S", "N"), ("TF", "T", "F"), ("JP", "J", "P")]))
    out["label_encode"] = f"{_with(S.posts_cte())} SELECT row_id, type, {enc} FROM posts"
    out["stratified_split"] = f"{_with(S.posts_cte(), _split_cte())} SELECT row_id, type, split FROM split"
    folds = f"""
    first AS (SELECT dim, label, min(row_id) AS f, count(*) AS n FROM lab GROUP BY ALL),
    starts AS (SELECT dim, label, n, sum(n) OVER (PARTITION BY dim ORDER BY f) - n AS s FROM first),
    rk AS (SELECT lab.*, row_number() OVER (PARTITION BY dim, label ORDER BY row_id) - 1 AS r FROM lab),
    fa AS (SELECT rk.*, {', '.join(f"greatest(0, floor((st.s + st.n - {i} + 2) / 3)) - greatest(0, floor((st.s - {i} + 2) / 3)) AS a{i}" for i in range(3))}
           FROM rk JOIN starts st USING (dim, label)),
    folds AS (SELECT row_id, dim, label, CAST(CASE WHEN r < a0 THEN 0 WHEN r < a0 + a1 THEN 1 ELSE 2 END AS INTEGER) AS fold FROM fa)"""
    out["stratified_folds"] = f"{_with(S.posts_cte(), _long_labels(), folds)} SELECT * FROM folds"

    base = [S.posts_cte(), _posts_texts("baseline"), _long_labels(), _tfidf_ctes()]
    out["tfidf_vocab"] = f"{_with(*base)} SELECT term, round(idf, 6) AS idf FROM vocab"
    out["tfidf_vocab_frequent"] = out["tfidf_vocab"]
    out["tfidf_weights"] = f"{_with(*base)} SELECT row_id, term, round(x, 6) AS x FROM xf"
    out["nb_model"] = f"""{_with(*base, _nb_fit_ctes('SELECT * FROM lab'))}
    SELECT l.dim, l.label, l.term, round(l.logp, 6) AS logp, round(p.prior, 6) AS prior
    FROM logp l JOIN prior p ON p.dim = l.dim AND p.label = l.label"""
    cv_train = "SELECT f.row_id, f.dim, f.label, m.mf AS model_fold FROM folds f, (VALUES (0), (1), (2)) m(mf) WHERE f.fold <> m.mf"
    out["nb_cv_accuracy"] = f"""{_with(*base, folds, _nb_fit_ctes(cv_train, 'model_fold'))},
    dotp AS (SELECT f.row_id, f.dim, lp.label, sum(x.x * lp.logp) AS dot
             FROM folds f JOIN xf x ON x.row_id = f.row_id
                  JOIN logp lp ON lp.model_fold = f.fold AND lp.dim = f.dim AND lp.term = x.term GROUP BY ALL),
    jll AS (SELECT f.row_id, f.dim, f.fold, f.label AS y, p.label, p.prior + coalesce(d.dot, 0.0) AS jll
            FROM folds f JOIN prior p ON p.model_fold = f.fold AND p.dim = f.dim
            LEFT JOIN dotp d ON d.row_id = f.row_id AND d.dim = f.dim AND d.label = p.label),
    pj AS (SELECT row_id, dim, fold, any_value(y) AS y, max(jll) FILTER (WHERE label = 0) AS j0,
                  max(jll) FILTER (WHERE label = 1) AS j1 FROM jll GROUP BY row_id, dim, fold),
    acc AS (SELECT dim, fold, avg(CASE WHEN (CASE WHEN j0 IS NULL THEN 1 WHEN j1 IS NULL THEN 0 WHEN j1 > j0 THEN 1 ELSE 0 END) = y
                                      THEN 1.0 ELSE 0.0 END) AS acc FROM pj GROUP BY dim, fold)
    SELECT dim, round(avg(acc), 6) AS accuracy_mean, round(stddev_pop(acc), 6) AS accuracy_std,
           CAST(count(*) AS BIGINT) AS n_folds FROM acc GROUP BY dim"""

    xf_id = "xfid AS (SELECT row_id AS id, term, x FROM xf)"
    out["eval_metrics"] = f"""{_with(*_model_ctes(), xf_id, _nb_pred_ctes('SELECT row_id AS id FROM posts', 'xfid'))}
    SELECT s.split, p.dim, CAST(count(*) AS BIGINT) AS n_rows,
           round(avg(CASE WHEN (CASE WHEN p.p1 > 0.5 THEN 1 ELSE 0 END) = l.label THEN 1.0 ELSE 0.0 END), 6) AS accuracy,
           round(avg(-(l.label * ln(least(greatest(p.p1, 1e-12), 1 - 1e-12))
                       + (1 - l.label) * ln(1 - least(greatest(p.p1, 1e-12), 1 - 1e-12)))), 6) AS bce_loss
    FROM pred p JOIN lab l ON l.row_id = p.id AND l.dim = p.dim JOIN split s ON s.row_id = p.id
    GROUP BY s.split, p.dim"""

    from ..functions.wordlists import HEAD_EPOCHS, HEAD_PATIENCE, MAX_INPUT_TOKENS
    from ..operators.heads import LEARNING_RATE

    heads = _head_ctes(LEARNING_RATE, HEAD_EPOCHS, HEAD_PATIENCE)
    out["head_training"] = f"""{_with(*heads)}
    SELECT CAST(epoch AS BIGINT) AS epoch, dim, round(train_loss, 6) AS train_loss, round(val_loss, 6) AS val_loss,
           epoch = (SELECT epoch FROM chosen) AS chosen FROM el WHERE epoch IN (SELECT epoch FROM ek)"""
    wide_w = ", ".join(f"round(max(w) FILTER (WHERE dim = '{d}'), 6) AS w_{d}" for d in ["EI", "SN", "TF", "JP"])
    out["head_weights"] = f"{_with(*heads)} SELECT term, {wide_w} FROM heads GROUP BY term"
    out["head_metrics"] = f"""{_with(*heads, xf_id, _head_pred_ctes('SELECT row_id AS id FROM posts', 'xfid'))}
    SELECT s.split, p.dim, CAST(count(*) AS BIGINT) AS n_rows,
           round(avg(CASE WHEN (CASE WHEN p.p1 > 0.5 THEN 1 ELSE 0 END) = l.label THEN 1.0 ELSE 0.0 END), 6) AS accuracy,
           round(avg(-(l.label * ln(least(greatest(p.p1, 1e-12), 1 - 1e-12))
                       + (1 - l.label) * ln(1 - least(greatest(p.p1, 1e-12), 1 - 1e-12)))), 6) AS bce_loss
    FROM pred p JOIN lab l ON l.row_id = p.id AND l.dim = p.dim JOIN split s ON s.row_id = p.id
    GROUP BY s.split, p.dim"""
    hchar = f"""
    htok AS (SELECT id, unnest({S.vectorizer_tokens('text')}) AS term FROM
             (SELECT show_key || chr(1) || character_key AS id, text FROM ctext WHERE text <> '')),
    hcnt AS (SELECT id, term, count(*) AS cnt FROM htok GROUP BY ALL),
    hx0 AS (SELECT c.id, c.term, c.cnt * v.idf AS x0 FROM hcnt c JOIN vocab v ON v.term = c.term),
    hxf AS (SELECT id, term, x0 / sqrt(sum(x0 * x0) OVER (PARTITION BY id)) AS x FROM hx0)"""
    hrows = "SELECT show_key || chr(1) || character_key AS id FROM ctext WHERE text <> ''"
    out["head_character_types"] = f"""{_with(dl, *heads, _char_texts_ctes(), hchar, _head_pred_ctes(hrows, 'hxf'), f"cw AS ({_wide('pred')})")}
    SELECT t.show_key, t.character_key, t.n_lines, round(w.p_EI, 6) AS p_EI, round(w.p_SN, 6) AS p_SN,
           round(w.p_TF, 6) AS p_TF, round(w.p_JP, 6) AS p_JP, w.mbti
    FROM ctext t JOIN cw w ON w.id = t.show_key || chr(1) || t.character_key WHERE t.text <> ''"""
    cut = _char_types_ctes()
    cut[len(_model_ctes())] = cut[len(_model_ctes())].replace("ctext AS (", "ctext0 AS (") + f""",
    ctext AS (SELECT show_key, character_key, n_lines,
                     {S.first_words('text', MAX_INPUT_TOKENS)} AS text FROM ctext0)"""
    out["limited_character_types"] = f"{_with(dl, *cut)} SELECT * FROM ctypes"

    out["character_types"] = f"{_with(dl, *_char_types_ctes())} SELECT * FROM ctypes"
    out["character_lookup"] = f"""{_with(dl, *_char_types_ctes())},
    asked AS (SELECT DISTINCT show_key, unnest([upper(character), 'Nobody']) AS character FROM lines WHERE character IS NOT NULL)
    SELECT a.show_key || '/' || a.character AS request_id, t.mbti IS NOT NULL AS success,
           CASE WHEN t.mbti IS NULL THEN 'No dialogue found for ' || a.character || ' in ' || a.show_key END AS error,
           t.mbti, t.n_lines
    FROM asked a LEFT JOIN ctypes t ON t.show_key = a.show_key AND t.character_key = lower(a.character)"""
    axes = " UNION ALL ".join(
        f"SELECT show_key, character_key, '{d}' AS axis, '{n}' AS letter, 1.0 - p_{d} AS p FROM ctypes UNION ALL "
        f"SELECT show_key, character_key, '{d}', '{p}', p_{d} FROM ctypes"
        for d, p, n in [("EI", "E", "I"), ("SN", "S", "N"), ("TF", "T", "F"), ("JP", "J", "P")])
    order = " || ',' || ".join(
        f"CASE WHEN p_{d} >= 0.5 THEN '{p}{n}' ELSE '{n}{p}' END"
        for d, p, n in [("EI", "E", "I"), ("SN", "S", "N"), ("TF", "T", "F"), ("JP", "J", "P")])
    out["probability_map"] = f"""{_with(dl, *_char_types_ctes())}
    SELECT x.show_key, x.character_key, x.axis, x.letter, round(x.p, 6) AS p, {order} AS "order"
    FROM ({axes}) x JOIN ctypes t ON t.show_key = x.show_key AND t.character_key = x.character_key"""
    out["show_personalities"] = f"""{_with(dl, *_char_types_ctes(), f"cnt AS ({counts})")}
    SELECT c.show_key, c.character, c.n_lines,
           row_number() OVER (PARTITION BY c.show_key ORDER BY c.n_lines DESC, c.character) AS count_rank, t.mbti
    FROM cnt c JOIN ctypes t ON t.show_key = c.show_key AND t.character_key = lower(c.character)
    QUALIFY count_rank <= 2"""
    qtexts = f"""SELECT l.show_key || ':' || CAST(l.line_no AS VARCHAR) AS id,
                 {S.normalize_classifier('l.dialogue')} AS text
                 FROM lines l JOIN ctypes t ON t.show_key = l.show_key AND t.character_key = lower(l.character)"""
    match = " + ".join(
        f"(CASE WHEN substr(t.mbti, {i + 1}, 1) = '{p}' THEN w.p_{d} ELSE 1.0 - w.p_{d} END)"
        for i, (d, p) in enumerate([("EI", "E"), ("SN", "S"), ("TF", "T"), ("JP", "J")]))
    out["quote_scores"] = f"""{_with(dl, *_char_types_ctes(), _score_texts_ctes("l", qtexts), f"lw AS ({_wide('lpred')})")}
    SELECT l.show_key, lower(l.character) AS character_key,
           row_number() OVER (PARTITION BY l.show_key, lower(l.character) ORDER BY round(({match}) / 4.0, 6) DESC, l.line_no) AS quote_rank,
           l.line_no, l.season, l.episode, l.episode_title, l.dialogue AS dialogue_raw, round(({match}) / 4.0, 6) AS score
    FROM lines l JOIN ctypes t ON t.show_key = l.show_key AND t.character_key = lower(l.character)
         JOIN lw w ON w.id = l.show_key || ':' || CAST(l.line_no AS VARCHAR)
    QUALIFY quote_rank <= {K}"""

    mq = S.lit(CT.MOMENT_QUERY)
    mparts = S.display_parts(mq)
    out["character_moments"] = f"""{_with(dl, *_char_types_ctes())},
    hits AS (SELECT l.show_key, lower(l.character) AS character_key, l.season, l.episode, l.episode_title, l.line_no,
                    coalesce(l.dialogue, '') AS full_dialogue
             FROM lines l JOIN ctypes t ON t.show_key = l.show_key AND t.character_key = lower(l.character)
             WHERE contains(lower(coalesce(l.dialogue, '')), lower({mq}))),
    mtot AS (SELECT show_key, character_key, CAST(count(*) AS BIGINT) AS total_matches FROM hits GROUP BY ALL)
    SELECT h.show_key, h.character_key,
           row_number() OVER (PARTITION BY h.show_key, h.character_key ORDER BY h.line_no) AS moment_rank,
           h.line_no, h.season, h.episode, h.episode_title,
           {S.highlight(S.snippet('h.full_dialogue', mparts), mparts)} AS snippet, h.full_dialogue, t.total_matches
    FROM hits h JOIN mtot t ON t.show_key = h.show_key AND t.character_key = h.character_key
    QUALIFY moment_rank <= {K}"""

    res = search_sql(dl, CT.DIALOGUE_QUERIES, K, TW)
    res_body = res.strip()[len("WITH"):]
    res_body = res_body[: res_body.rindex("SELECT query_id, query, show_key")]
    out["search_with_characters"] = f"""WITH {res_body.rstrip().rstrip(',')},
    {_char_types_ctes_inline()},
    fc AS (SELECT show_key, character, row_number() OVER (PARTITION BY show_key ORDER BY min(line_no), character) AS appearance_rank
           FROM lines WHERE character IS NOT NULL GROUP BY show_key, character QUALIFY appearance_rank <= 2),
    shows AS (SELECT DISTINCT query_id, show_key FROM top)
    SELECT s.query_id, s.show_key, f.character, f.appearance_rank, t.mbti
    FROM shows s JOIN fc f ON f.show_key = s.show_key
         JOIN ctypes t ON t.show_key = f.show_key AND t.character_key = lower(f.character)"""

    out["cosine_topk"] = f"{_with(*_style_ctes())} SELECT request_id, character, example_rank, line_id, cosine FROM near"
    out["cosine_topk_index"] = out["cosine_topk"]
    sent = CT.STYLE_SENTENCE.replace("'", "''")
    out["style_prompts"] = f"""{_with(*_style_ctes())}
    SELECT request_id, character, CAST(count(*) AS BIGINT) AS n_examples,
           chr(10) || 'Rewrite the following sentence in the style of **' || character || '**.' || chr(10) || chr(10)
           || 'Examples:' || chr(10)
           || string_agg(CAST(example_rank AS VARCHAR) || '. ' || dialogue, chr(10) ORDER BY example_rank)
           || chr(10) || chr(10) || 'Sentence: "{sent}"' || chr(10) || 'Output:' || chr(10) AS prompt
    FROM near GROUP BY request_id, character"""
    return out


def _char_types_ctes_inline() -> str:
    return ",\n".join(c.strip() for c in _char_types_ctes())
