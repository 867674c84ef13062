"""The SQL that gives the same rows as `evaluation_queries`."""

from __future__ import annotations

from corpuslens.functions.text import LEAD_WORDS, MEDICAL_AFFIXES, NO_EVIDENCE, PROMPT, STOP_WORDS

_WS = "'^\\s+|\\s+$', '', 'g'"
CORPUS = """corpus AS (
  SELECT _id AS doc_id, coalesce(title, '') AS title, coalesce(text, CASE WHEN passage <> 'nan' THEN passage END, '') AS text
  FROM (SELECT *, row_number() OVER (PARTITION BY _id ORDER BY loaded_at DESC) AS k FROM corpus_ds) WHERE k = 1 AND NOT coalesce(deleted, false)),
prep AS (SELECT doc_id, regexp_replace(title || ' ' || text, '^\\s+|\\s+$', '', 'g') AS content FROM corpus)"""
QUERY = """queries AS (
  SELECT _id AS qid, coalesce(text, '') AS text
  FROM (SELECT *, row_number() OVER (PARTITION BY _id ORDER BY loaded_at DESC) AS k FROM queries_ds) WHERE k = 1 AND NOT coalesce(deleted, false))"""
QRELS = f"""judged AS (
  SELECT qid, doc_id, arg_max(rel, qrel_no) AS rel, split FROM (
    SELECT lower(regexp_replace("query-id", {_WS})) AS qid, lower(regexp_replace("corpus-id", {_WS})) AS doc_id, score AS rel, split, qrel_no FROM qrels_ds)
  WHERE qid IS NOT NULL AND qid <> '' AND doc_id IS NOT NULL AND doc_id <> '' AND rel IS NOT NULL AND split IS NOT NULL GROUP BY qid, doc_id, split),
qrels AS (
  SELECT qid, doc_id, rel FROM (
    SELECT *, rank() OVER (PARTITION BY qid ORDER BY CASE split WHEN 'train' THEN 0 WHEN 'dev' THEN 1 ELSE 2 END DESC) AS k FROM judged) WHERE k = 1)"""
RUN = """run AS (
  SELECT method, qid, doc_id, max(score) AS score FROM retrieval
  WHERE method IS NOT NULL AND qid IS NOT NULL AND doc_id IS NOT NULL AND score IS NOT NULL AND NOT isnan(score) GROUP BY 1, 2, 3)"""
RANKED = "ranked AS (SELECT *, row_number() OVER (PARTITION BY method, qid ORDER BY round(score, 6) DESC, doc_id) AS rank FROM run)"
JOINED = """joined AS (
  SELECT coalesce(a.qid, b.qid) AS qid, coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(a.score, 0) AS a, coalesce(b.score, 0) AS b
  FROM (SELECT * FROM run WHERE method = 'BM25') a FULL JOIN (SELECT * FROM run WHERE method = '{other}') b ON a.qid = b.qid AND a.doc_id = b.doc_id),
norm AS (
  SELECT qid, doc_id, CASE WHEN max(a) OVER w > min(a) OVER w THEN (a - min(a) OVER w) / (max(a) OVER w - min(a) OVER w) ELSE 0 END AS a,
         CASE WHEN max(b) OVER w > min(b) OVER w THEN (b - min(b) OVER w) / (max(b) OVER w - min(b) OVER w) ELSE 0 END AS b
  FROM joined WINDOW w AS (PARTITION BY qid)),
hybrid AS (SELECT qid, doc_id, 0.4::DOUBLE * a + 0.6::DOUBLE * b AS score FROM norm)"""
FUSED = JOINED.format(other="Dense")
WORD = "list_transform(regexp_extract_all({}, '[A-Za-z][A-Za-z0-9\\-]+'), lambda x: lower(x))"
_STOP = "[" + ", ".join(f"'{w}'" for w in STOP_WORDS) + "]"
BM = "list_filter(regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda x: NOT list_contains(" + _STOP + ", x))"
NUMBER = "TRY_CAST(nullif(regexp_extract({}, '([0-9]{{1,18}})[^0-9]*$', 1), '') AS BIGINT)"


def _scrambled(x: str) -> str:
    y = f"(({x}) % 2147483647)"
    for add in (7, 101, 977):
        y = f"(list_transform([{y}::BIGINT], lambda y: (y * y + 3 * y + {add}) % 2147483647)[1])"
    return y


def _sample(col: str) -> str:
    return _scrambled(NUMBER.format(col) + " * 31 + 42")


def _gain(rel: str, rank: str) -> str:
    return f"(pow(2.0, {rel}) - 1) / log2({rank} + 1)"


def _ev(runs: str, qrels: str, keys: str, ks: tuple[int, ...], name: str = "ev") -> str:
    """CTEs that evaluate `runs` (keys, qid, doc_id, score) against `qrels`."""
    parts = ", ".join(
        f"sum(CASE WHEN rank <= {k} THEN {_gain('rel', 'rank')} END) AS dcg_{k}, sum(CASE WHEN rank <= {k} THEN hit ELSE 0 END) AS hits_{k}, "
        f"sum(CASE WHEN rank <= {k} THEN part ELSE 0 END) AS ap_{k}"
        for k in ks
    )
    ideal = ", ".join(f"sum(CASE WHEN r <= {k} THEN {_gain('rel', 'r')} END) AS idcg_{k}" for k in ks)
    out = ", ".join(
        f"CASE WHEN idcg_{k} > 0 THEN dcg_{k} / idcg_{k} ELSE 0 END AS ndcg_{k}, CASE WHEN n_rel > 0 THEN hits_{k} / n_rel ELSE 0 END AS recall_{k}, "
        f"hits_{k} / {k} AS p_{k}, CASE WHEN n_rel > 0 THEN ap_{k} / least(n_rel, {k}) ELSE 0 END AS map_{k}"
        for k in ks
    )
    return f"""{name}_r AS (SELECT *, row_number() OVER (PARTITION BY {keys}, qid ORDER BY round(score, 6) DESC, doc_id) AS rank FROM {runs}),
{name}_t AS (
  SELECT r.*, coalesce(q.rel, 0) AS rel, CASE WHEN q.rel >= 1 THEN 1 ELSE 0 END AS hit
  FROM {name}_r r LEFT JOIN {qrels} q ON r.qid = q.qid AND r.doc_id = q.doc_id WHERE rank <= {max(ks)}),
{name}_s AS (SELECT *, hit * (sum(hit) OVER (PARTITION BY {keys}, qid ORDER BY rank ROWS UNBOUNDED PRECEDING))::DOUBLE / rank AS part FROM {name}_t),
{name}_g AS (SELECT {keys}, qid, {parts} FROM {name}_s GROUP BY {keys}, qid),
{name}_i AS (
  SELECT qid, {ideal}, count(CASE WHEN rel >= 1 THEN 1 END) AS n_rel
  FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rel DESC, doc_id) AS r FROM {qrels}) GROUP BY qid),
{name} AS (SELECT {keys}, g.qid, {out} FROM {name}_g g JOIN {name}_i i ON g.qid = i.qid)"""


def _agg(by: str, ks: tuple[int, ...], frm: str) -> str:
    means = ", ".join(f"round(avg({m}_{k}), 6) AS {m}_{k}" for m in ("ndcg", "recall", "p", "map") for k in ks)
    return f"SELECT {by}, count(*) AS n_queries, {means}, round(avg(1 - ndcg_10), 6) AS risk, round(var_samp(1 - ndcg_10), 6) AS loss_variance FROM {frm} GROUP BY {by}"


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


KS = (1, 3, 5, 10)
_EV = _with(QRELS, RUN, _ev("run", "qrels", "method", KS))
_COLUMN = {"BM25": "bm25", "Dense": "dense", "BGE-small": "bge_small", "E5-small": "e5_small", "SPLADE": "splade", "MedCPT": "medcpt"}
_WIDE_CTE = f"""{_ev("run", "qrels", "method", (10,))},
pq AS (SELECT m.method, m.qid, coalesce(ev.ndcg_10, 0) AS ndcg FROM (SELECT DISTINCT method, qid FROM run) m LEFT JOIN ev ON m.method = ev.method AND m.qid = ev.qid),
wide AS (SELECT qid, {", ".join(f"max(CASE WHEN method = '{m}' THEN ndcg_10 END) AS {c}" for m, c in _COLUMN.items())} FROM ev GROUP BY qid),
both_ran AS (SELECT qid, bm25, dense FROM wide WHERE bm25 IS NOT NULL AND dense IS NOT NULL)"""
_WIDE = _with(QRELS, RUN, _WIDE_CTE)

_IDF = f"""df AS (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct({WORD.format('content')})) AS term FROM prep) GROUP BY term),
idf AS (SELECT term, df, ln(((SELECT count(*) FROM corpus)::DOUBLE + 1) / (df + 1)) + 1 AS idf FROM df)"""
_TECH = f"""tech AS (
  SELECT q.qid, coalesce(t.tech, 0) AS tech FROM queries q LEFT JOIN (
    SELECT qid, avg(coalesce(idf, 1)) AS tech FROM (SELECT qid, unnest({WORD.format('text')}) AS term FROM queries) w LEFT JOIN idf ON w.term = idf.term GROUP BY qid) t ON q.qid = t.qid)"""
_GAP = f"""qw AS (SELECT qid, list_distinct({WORD.format('text')}) AS q FROM queries),
dw AS (SELECT doc_id, list_distinct({WORD.format('content')}) AS d FROM prep),
best AS (
  SELECT r.qid, max(len(list_intersect(q, d))::DOUBLE / nullif(len(q), 0)) AS best FROM (SELECT DISTINCT qid, doc_id FROM qrels) r
  JOIN qw ON r.qid = qw.qid JOIN dw ON r.doc_id = dw.doc_id GROUP BY r.qid),
gap AS (SELECT qw.qid, CASE WHEN len(q) = 0 THEN 0 ELSE 1 - coalesce(best, 0) END AS gap FROM qw LEFT JOIN best ON qw.qid = best.qid)"""
_MED = f"CASE WHEN len({WORD.format('text')}) > 0 THEN len(list_filter({WORD.format('text')}, lambda x: regexp_matches(x, '{'|'.join(MEDICAL_AFFIXES)}')))::DOUBLE / len({WORD.format('text')}) ELSE 0 END"
_QUESTION = f"CAST(regexp_matches(text, '(?i)^\\s*({'|'.join(LEAD_WORDS)})\\b') AS BIGINT)"
_STUDY = _with(
    CORPUS, QUERY, QRELS, RUN, FUSED,
    "three AS (SELECT CASE method WHEN 'BM25' THEN 'bm25' ELSE 'dense' END AS method, qid, doc_id, score FROM run WHERE method IN ('BM25', 'Dense') UNION ALL SELECT 'hybrid', qid, doc_id, score FROM hybrid)",
    _ev("three", "qrels", "method", (10,)),
    "w AS (SELECT qid, " + ", ".join(f"max(CASE WHEN method = '{m}' THEN ndcg_10 END) AS {m}" for m in ("bm25", "dense", "hybrid")) + " FROM ev GROUP BY qid HAVING count(*) = 3)",
    _IDF, _TECH, _GAP,
    f"study AS (SELECT w.*, dense - bm25 AS dense_minus_bm25, hybrid - dense AS hybrid_minus_dense, gap, tech, len({WORD.format('q.text')}) AS len "
    "FROM w JOIN queries q ON w.qid = q.qid JOIN gap ON w.qid = gap.qid JOIN tech ON w.qid = tech.qid)",
)
_TRIALS = ["bm25", "dense", "hybrid", "dense_minus_bm25", "hybrid_minus_dense"]


def _draws(replicates: int, size: str, n: str) -> str:
    return f"draws AS (SELECT id // {size} AS b, {_scrambled('id * 7919 + 12345')} % {n} AS idx FROM (SELECT unnest(range({replicates} * {size})) AS id))"


_SIZE = "(SELECT count(DISTINCT qid) FROM queries WHERE qid IN (SELECT qid FROM judged WHERE split = 'test'))"
_RESAMPLED = _STUDY.rstrip() + f""",
placed AS (SELECT *, row_number() OVER (ORDER BY qid) - 1 AS idx FROM study),
{_draws(2000, _SIZE, "(SELECT count(*) FROM study)")},
trials AS (SELECT b AS trial, {", ".join(f"avg({c}) AS {c}" for c in _TRIALS)} FROM draws JOIN placed ON draws.idx = placed.idx GROUP BY b)
"""
_SPEARMAN = [("gap vs bm25", "gap", "bm25"), ("gap vs dense", "gap", "dense"), ("gap vs hybrid", "gap", "hybrid"), ("overlap vs dense - bm25", "1 - gap", "dense_minus_bm25")]
_STRATA = """, r AS (SELECT *, row_number() OVER (ORDER BY round({by}, 9), qid) - 1 AS r, count(*) OVER () AS n FROM study)
SELECT (CASE WHEN 3 * r >= n - 1 THEN 1 ELSE 0 END + CASE WHEN 3 * r >= 2 * (n - 1) THEN 1 ELSE 0 END)::BIGINT AS stratum, count(*) AS n_queries, """ + ", ".join(f"round(avg({c}), 6) AS {c}" for c in _TRIALS) + " FROM r GROUP BY 1"
_ANSWER = "CASE WHEN regexp_matches(lower({0}), '\\byes\\b') THEN 'yes' WHEN regexp_matches(lower({0}), '\\bno\\b') THEN 'no' WHEN regexp_matches(lower({0}), '\\bmaybe\\b') THEN 'maybe' ELSE 'unknown' END"
_TOP5 = """ctx AS (
  SELECT q.qid, q.text, '{m}' AS method, coalesce(p.passages, []) AS passages
  FROM (SELECT * FROM queries WHERE qid IN (SELECT qid FROM qrels)) q LEFT JOIN (
    SELECT r.qid, list(content ORDER BY rank) AS passages FROM ranked r JOIN prep ON r.doc_id = prep.doc_id WHERE rank <= 5 AND method = '{m}' GROUP BY r.qid) p ON q.qid = p.qid)"""
_CTX = _with(CORPUS, QUERY, QRELS, RUN, RANKED, _TOP5.format(m="BM25"))
_STRATEGIES = _with(
    QRELS, RUN, JOINED.format(other="BGE-small"), _WIDE_CTE, "hy AS (SELECT 'h' AS method, * FROM hybrid)", _ev("hy", "qrels", "method", (10,), "hev"),
    "st AS (SELECT wide.qid, bm25, bge_small AS bge, hev.ndcg_10 AS hybrid, medcpt FROM wide JOIN hev ON wide.qid = hev.qid WHERE bm25 IS NOT NULL AND bge_small IS NOT NULL AND medcpt IS NOT NULL)",
)
_BM25 = _with(
    CORPUS, QUERY, f"qs AS (SELECT * FROM queries WHERE {NUMBER.format('qid')} % 50 = 0)",
    f"tok AS (SELECT doc_id, {BM.format('content')} AS t FROM prep)",
    "dl AS (SELECT doc_id, len(t) AS dl FROM tok), st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl)",
    "post AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM tok) GROUP BY 1, 2), df AS (SELECT term, count(*) AS df FROM post GROUP BY 1)",
    f"qt AS (SELECT qid, term, count(*) AS qtf FROM (SELECT qid, unnest({BM.format('text')}) AS term FROM qs) GROUP BY 1, 2)",
    "sc AS (SELECT qid, p.doc_id, sum(qtf * ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))) AS score "
    "FROM qt JOIN post p ON qt.term = p.term JOIN df ON df.term = qt.term JOIN dl ON dl.doc_id = p.doc_id CROSS JOIN st GROUP BY 1, 2)",
)
_BMR = "SELECT qid, doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 6) DESC, doc_id) AS rank FROM "
_LEX = f"""cand AS (SELECT qid, doc_id FROM ranked WHERE method = 'BM25' AND rank <= 100),
lex AS (
  SELECT c.qid, c.doc_id, CASE WHEN len(q) > 0 THEN len(list_intersect(q, d))::DOUBLE / len(q) ELSE 0 END AS score FROM cand c
  JOIN (SELECT qid, list_distinct({WORD.format('text')}) AS q FROM queries) x ON c.qid = x.qid JOIN (SELECT doc_id, list_distinct({WORD.format('content')}) AS d FROM prep) y ON c.doc_id = y.doc_id)"""
_SUBSET = """ju AS (SELECT doc_id FROM corpus WHERE doc_id IN (SELECT doc_id FROM qrels)),
di AS (SELECT doc_id FROM corpus WHERE doc_id NOT IN (SELECT doc_id FROM qrels) ORDER BY """ + _sample("doc_id") + """ NULLS FIRST, doc_id LIMIT greatest(0, least(50000 - (SELECT count(*) FROM ju), 10000)))"""
_SPARSE = """sp AS (SELECT vec_id, unnest(range(64)) AS term, unnest(embedding)::DOUBLE * 4 AS logit FROM embeddings WHERE vec_id IS NOT NULL),
pool AS (SELECT vec_id, term, max(ln(1 + greatest(logit, 0)) * CASE WHEN term < 63 THEN 1 ELSE 0 END) AS weight FROM sp GROUP BY 1, 2 HAVING weight > 0)"""
_SPLIT = {split: f"q_{split} AS (SELECT qid, doc_id, rel FROM judged WHERE split = '{split}')" for split in ("train", "dev", "test")}
_THREE = "three AS (SELECT method, qid, doc_id, score FROM run WHERE method IN ('BM25', 'Dense') UNION ALL SELECT 'Hybrid', qid, doc_id, score FROM hybrid)"
_RRF = "rrf AS (SELECT qid, doc_id, sum(1.0::DOUBLE / (60 + rank)) AS score FROM ranked WHERE method IN ('BM25', 'Dense') GROUP BY 1, 2)"
_PIVOT = _with(
    QRELS, RUN, _ev("run", "qrels", "method", (10,)),
    "src AS (SELECT _id AS qid, min(lower(trim(source))) AS dataset FROM queries_ds WHERE source IS NOT NULL GROUP BY 1)",
    "wide AS (SELECT dataset, " + ", ".join(f"round(avg(CASE WHEN method = '{m}' THEN ndcg_10 END), 4) AS {c}" for m, c in _COLUMN.items()) + " FROM ev JOIN src ON ev.qid = src.qid GROUP BY 1)",
)


def _ols() -> str:
    """Least squares on three standardised features, by determinants of their correlations."""
    z = {c: f"({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER ()" for c in ("gap", "len", "tech")}
    det = lambda m: f"({m[0]}*({m[4]}*{m[8]}-{m[5]}*{m[7]})-{m[1]}*({m[3]}*{m[8]}-{m[5]}*{m[6]})+{m[2]}*({m[3]}*{m[7]}-{m[4]}*{m[6]}))"
    r = ["1", "ab", "ac", "ab", "1", "bc", "ac", "bc", "1"]
    put = lambda k: [("ya", "yb", "yc")[i // 3] if i % 3 == k else r[i] for i in range(9)]
    explained = " + ".join(f"{det(put(k))} / {det(r)} * y{c}" for k, c in enumerate("abc"))
    rows = " UNION ALL ".join(f"SELECT '{n}' AS feature, round({e}, 6) AS coef, round(({explained}) / v, 6) AS r2 FROM m" for n, e in [("Intercept", "y"), *((c, f"{det(put(k))} / {det(r)}") for k, c in enumerate(z))])
    return (
        f", z AS (SELECT {', '.join(f'{e} AS z_{c}' for c, e in z.items())}, dense_minus_bm25 AS y FROM study), "
        "m AS (SELECT avg(y) AS y, var_pop(y) AS v, avg(z_gap*z_len) AS ab, avg(z_gap*z_tech) AS ac, avg(z_len*z_tech) AS bc, avg(z_gap*y) AS ya, avg(z_len*y) AS yb, avg(z_tech*y) AS yc FROM z) " + rows
    )


def _ols_bootstrap(replicates: int) -> str:
    """The same regression for each replicate, of features standardised once, from its covariances."""
    det = lambda m: f"({m[0]}*({m[4]}*{m[8]}-{m[5]}*{m[7]})-{m[1]}*({m[3]}*{m[8]}-{m[5]}*{m[6]})+{m[2]}*({m[3]}*{m[7]}-{m[4]}*{m[6]}))"
    sums = ", ".join([*(f"avg({c}) AS m{c}" for c in "uvwy"), *(f"avg({a} * {b}) - avg({a}) * avg({b}) AS {a}{b}" for a, b in ("uu", "uv", "uw", "vv", "vw", "ww", "uy", "vy", "wy"))])
    r = ["uu", "uv", "uw", "uv", "vv", "vw", "uw", "vw", "ww"]
    put = lambda k: [("uy", "vy", "wy")[i // 3] if i % 3 == k else r[i] for i in range(9)]
    slopes = ", ".join(f"{det(put(k))} / {det(r)} AS s{c}" for k, c in enumerate("uvw"))
    long = " UNION ALL ".join(f"SELECT '{n}' AS feature, {e} AS boot FROM fits" for n, e in (("Intercept", "my - su * mu - sv * mv - sw * mw"), ("gap", "su"), ("len", "sv"), ("tech", "sw")))
    whole = _ols().lstrip(", ")
    z, points = whole[: whole.index("SELECT 'Intercept'")], whole[whole.index("SELECT 'Intercept'") :]
    z = z.replace("AS y FROM study", "AS y, qid FROM study")
    return f""", {z}, points AS ({points}),
placed AS (SELECT z_gap AS u, z_len AS v, z_tech AS w, y, row_number() OVER (ORDER BY qid) - 1 AS idx FROM z),
{_draws(replicates, "(SELECT count(*) FROM study)", "(SELECT count(*) FROM study)")},
sums AS (SELECT {sums} FROM draws JOIN placed ON draws.idx = placed.idx GROUP BY draws.b),
fits AS (SELECT *, {slopes} FROM sums), boots AS ({long}),
ci AS (
  SELECT p.feature, coef, quantile_cont(boot, 0.025) AS lo, quantile_cont(boot, 0.975) AS hi, round(CASE WHEN coef = 0 THEN 1 ELSE avg(CASE WHEN boot * sign(coef) <= 0 THEN 1 ELSE 0 END) END, 4) AS p_boot
  FROM points p JOIN boots ON p.feature = boots.feature GROUP BY 1, 2)
SELECT feature, coef, round(lo, 6) AS ci_lo, round(hi, 6) AS ci_hi, p_boot, CASE WHEN p_boot < 0.001 THEN '***' WHEN p_boot < 0.01 THEN '**' WHEN p_boot < 0.05 THEN '*' ELSE '' END AS sig FROM ci"""


_HEAD, _MID, _TAIL = (x.replace("'", "''") for x in (PROMPT.split("{q}")[0], *PROMPT.split("{q}")[1].split("{ctx}")))

SQL = {
    "prep_corpus": _with(CORPUS) + "SELECT doc_id, content FROM prep",
    "tokens_word": _with(CORPUS, f"t AS (SELECT doc_id, {WORD.format('content')} AS t FROM prep)") + "SELECT doc_id, len(t) AS n, len(list_distinct(t)) AS n_distinct, array_to_string(t, ' ') AS tokens FROM t",
    "tokens_bm25": _with(CORPUS, f"t AS (SELECT doc_id, {BM.format('content')} AS t FROM prep)") + "SELECT doc_id, len(t) AS n, array_to_string(t, ' ') AS tokens FROM t",
    "feat_is_question": _with(QUERY) + f"SELECT qid, {_QUESTION} AS is_question FROM queries",
    "feat_med_share": _with(QUERY) + f"SELECT qid, round({_MED}, 6) AS med_share FROM queries",
    "qa_normalise": _with(CORPUS) + f"SELECT doc_id, {_ANSWER.format('text')} AS answer FROM corpus",
    "qa_to_qrels": _with(CORPUS, """qa AS (
  SELECT coalesce(id, row_no::VARCHAR) AS qid, arg_max({'q': question, 'r': relevant_passage_ids}, row_no) AS x FROM qa_ds GROUP BY 1),
ids AS (SELECT qid, x.q AS question, unnest(coalesce(TRY_CAST(CASE WHEN json_valid(x.r) THEN x.r::JSON END AS VARCHAR[]), TRY_CAST(CASE WHEN json_valid(replace(x.r, '\'\'', '"')) THEN replace(x.r, '\'\'', '"')::JSON END AS VARCHAR[]), [])) AS doc_id FROM qa)""")
    + "SELECT DISTINCT qid, doc_id, 1::BIGINT AS rel FROM ids WHERE question <> '' AND doc_id IN (SELECT doc_id FROM corpus WHERE text <> '' AND text <> 'nan')",
    "qa_passages": _with(CORPUS, "l AS (SELECT doc_id AS k, list_filter(string_split(text, chr(10)), lambda x: x <> '') AS c FROM corpus)")
    + "SELECT k || '_p' || (unnest(range(len(c))))::VARCHAR AS doc_id, '' AS title, unnest(c) AS text FROM l",
    "load_collection": _with(QUERY, QRELS) + "SELECT qid, text FROM queries WHERE qid IN (SELECT qid FROM judged WHERE split = 'test')",
    "collection_files": _with(CORPUS, QUERY, QRELS,
        "a AS (SELECT split, count(*) AS n_queries, sum(length(text))::BIGINT AS query_chars FROM (SELECT DISTINCT split, qid FROM judged) JOIN queries USING (qid) GROUP BY 1)",
        "b AS (SELECT split, count(*) AS n_judgements, sum(rel)::BIGINT AS rel_sum FROM judged GROUP BY 1)",
        "c AS (SELECT count(*) AS n_docs, sum(length(title) + length(text))::BIGINT AS doc_chars FROM corpus)")
    + "SELECT a.split, n_queries, query_chars, n_judgements, rel_sum, n_docs, doc_chars FROM a JOIN b USING (split) CROSS JOIN c WHERE split IN ('train', 'dev', 'test')",
    "join_run_qrels": _with(QRELS, RUN, RANKED) + "SELECT r.method, coalesce(q.rel, 0)::BIGINT AS rel, count(*) AS n FROM ranked r LEFT JOIN qrels q ON r.qid = q.qid AND r.doc_id = q.doc_id WHERE rank <= 10 GROUP BY 1, 2",
    "join_fusion_outer": _with(RUN, FUSED) + "SELECT qid, doc_id, round(a, 6) AS a, round(b, 6) AS b FROM joined",
    "semi_judged": _with(CORPUS, QRELS) + "SELECT qid, count(*) AS n FROM qrels WHERE doc_id IN (SELECT doc_id FROM corpus) GROUP BY 1",
    "anti_distractors": _with(CORPUS, QRELS) + "SELECT doc_id FROM corpus WHERE doc_id NOT IN (SELECT doc_id FROM qrels)",
    "subset_ids": _with(CORPUS, QRELS, _SUBSET) + "SELECT doc_id, 'judged' AS kind FROM ju UNION ALL SELECT doc_id, 'distractor' FROM di",
    "subset_qrels": _with(CORPUS, QRELS, _SUBSET, "ids AS (SELECT * FROM ju UNION ALL SELECT * FROM di)", "within AS (SELECT * FROM qrels WHERE doc_id IN (SELECT doc_id FROM ids))",
                          "chosen AS (SELECT qid FROM (SELECT DISTINCT qid FROM within) ORDER BY " + _sample("qid") + " NULLS FIRST, qid LIMIT 500)")
    + "SELECT qid, doc_id, rel::BIGINT AS rel FROM within WHERE qid IN (SELECT qid FROM chosen)",
    "subset_sample": _with(CORPUS) + "SELECT doc_id FROM corpus ORDER BY " + _sample("doc_id") + " NULLS FIRST, doc_id LIMIT 500",
    "split_union": _with(QRELS) + "SELECT qid, count(*) AS n, sum(rel)::BIGINT AS rel_sum FROM qrels GROUP BY 1",
    "first_n_queries": _with(QUERY) + "SELECT qid, text FROM queries ORDER BY qid LIMIT 50",
    "rank_run": _with(RUN, RANKED) + "SELECT method, qid, doc_id, round(score, 6) AS score, rank FROM ranked",
    "topk_per_query": _with(RUN, RANKED) + "SELECT method, qid, rank, doc_id FROM ranked WHERE rank <= 5",
    "minmax_norm": _with(RUN) + "SELECT method, qid, doc_id, round(CASE WHEN max(score) OVER w > min(score) OVER w THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 0 END, 6) AS score FROM run WINDOW w AS (PARTITION BY method, qid)",
    "hybrid_fusion": _with(RUN, FUSED) + "SELECT qid, doc_id, round(score, 6) AS score FROM hybrid",
    "rrf_fusion": _with(RUN, RANKED, _RRF) + "SELECT qid, doc_id, round(score, 6) AS score FROM rrf",
    "bm25_index_stats": _BM25 + "SELECT (SELECT count(*) FROM df) AS n_terms, (SELECT sum(df) FROM df)::BIGINT AS n_postings, (SELECT max(df) FROM df) AS most, n AS n_docs, round(avgdl, 6) AS avgdl FROM st",
    "bm25_topk": _BM25 + "SELECT * FROM (" + _BMR + "sc) WHERE rank <= 100",
    "bm25_topk_padded": _BM25 + "SELECT * FROM (" + _BMR + "(SELECT q.qid, d.doc_id, coalesce(sc.score, 0) AS score FROM qs q CROSS JOIN dl d LEFT JOIN sc ON sc.qid = q.qid AND sc.doc_id = d.doc_id)) WHERE rank <= 100",
    "feat_bm25_top1": _BM25 + "SELECT qs.qid, round(coalesce(max(score), 0), 6) AS bm25_top1 FROM qs LEFT JOIN sc ON qs.qid = sc.qid GROUP BY 1",
    "dense_topk": """SELECT * FROM (SELECT q.vec_id AS qid, d.vec_id AS doc_id, round(list_dot_product(q.embedding::DOUBLE[], d.embedding::DOUBLE[]), 6) AS score,
      row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_dot_product(q.embedding::DOUBLE[], d.embedding::DOUBLE[]), 6) DESC, d.vec_id) AS rank
      FROM embeddings q, embeddings d WHERE q.vec_id % 50 = 0 AND q.embedding IS NOT NULL AND d.embedding IS NOT NULL) WHERE rank <= 10""",
    "sparse_pool": _with(_SPARSE) + "SELECT vec_id, term, round(weight, 6) AS weight FROM pool",
    "sparse_topk": _with(_SPARSE, "sc AS (SELECT q.vec_id AS qid, d.vec_id AS doc_id, sum(q.weight * d.weight) AS score FROM pool q JOIN pool d ON q.term = d.term WHERE q.vec_id % 50 = 0 GROUP BY 1, 2)") + "SELECT * FROM (" + _BMR + "sc) WHERE rank <= 10",
    "rerank_candidates": _with(CORPUS, QUERY, RUN, RANKED, _LEX) + _BMR + "lex",
    "rerank_top5": _with(CORPUS, QUERY, RUN, RANKED, _LEX) + "SELECT * FROM (" + _BMR + "lex) WHERE rank <= 5",
    "rerank_delta": _with(CORPUS, QUERY, QRELS, RUN, RANKED, *[
        c for m in ("BM25", "BGE-small") for c in (
            _LEX.replace("cand AS", f"cand_{m[1]} AS").replace("FROM cand c", f"FROM cand_{m[1]} c").replace("lex AS", f"lex_{m[1]} AS").replace("method = 'BM25'", f"method = '{m}'"),
            f"both_{m[1]} AS (SELECT 'first' AS stage, qid, doc_id, score FROM ranked WHERE method = '{m}' AND rank <= 100 UNION ALL SELECT 'reranked', * FROM lex_{m[1]})",
            _ev(f"both_{m[1]}", "qrels", "stage", (10,), f"e_{m[1]}"),
            f"g_{m[1]} AS (SELECT '{m}' AS method, avg(CASE WHEN stage = 'first' THEN ndcg_10 END) AS f, avg(CASE WHEN stage = 'reranked' THEN ndcg_10 END) AS r FROM e_{m[1]})",
        )])
    + "SELECT method, round(f, 6) AS first, round(r, 6) AS reranked, round(r - f, 6) AS delta FROM (SELECT * FROM g_M UNION ALL SELECT * FROM g_G)",
    **{f"metric_{n}": _EV + f"SELECT method, qid, {', '.join(f'round({m}_{k}, 6) AS {m}_{k}' for k in KS)} FROM ev" for n, m in (("ndcg", "ndcg"), ("recall", "recall"), ("precision", "p"), ("map", "map"))},
    "evaluate_wide": _EV + _agg("method", KS, "ev"),
    "per_query_ndcg": _WIDE + "SELECT method, qid, round(ndcg, 6) AS ndcg FROM pq",
    "risk_summary": _EV + "SELECT method, count(*) AS n_queries, round(avg(1 - ndcg_10), 6) AS risk, round(var_samp(1 - ndcg_10), 6) AS loss_variance FROM ev GROUP BY 1",
    "split_metrics": _with(QRELS, RUN, FUSED, _THREE, *_SPLIT.values(), *[_ev("three", f"q_{x}", "method", (10,), f"e_{x}") for x in _SPLIT])
    + " UNION ALL ".join(f"SELECT '{x}' AS split, method, n_queries, ndcg_10, recall_10, p_10, risk, loss_variance FROM ({_agg('method', (10,), f'e_{x}')})" for x in _SPLIT),
    "alpha_sweep": _with(QRELS, RUN, FUSED, _SPLIT["dev"], "sweep AS (SELECT round(k / 10.0::DOUBLE, 1)::DOUBLE AS alpha, qid, doc_id, round(k / 10.0::DOUBLE, 1) * a + (1 - round(k / 10.0::DOUBLE, 1)) * b AS score FROM norm, range(11) t(k))",
                         _ev("sweep", "q_dev", "alpha", (10,)), "g AS (SELECT alpha, avg(ndcg_10) AS n, avg(recall_10) AS r, avg(p_10) AS p FROM ev GROUP BY 1)")
    + "SELECT alpha, round(n, 6) AS ndcg_10, round(r, 6) AS recall_10, round(p, 6) AS p_10, round(1 - n, 6) AS risk, (SELECT alpha FROM g ORDER BY round(n, 9) DESC, alpha LIMIT 1) AS best_alpha FROM g",
    "test_comparison": _with(QRELS, RUN, FUSED, RANKED, _RRF, _SPLIT["test"], _THREE, "four AS (SELECT * FROM three UNION ALL SELECT 'RRF(k=60)', qid, doc_id, score FROM rrf)", _ev("four", "q_test", "method", (10,)))
    + f"SELECT method, ndcg_10, recall_10, p_10, risk, loss_variance FROM ({_agg('method', (10,), 'ev')})",
    "multi_dataset_pivot": _PIVOT + "SELECT * FROM wide",
    "report_backfill": _PIVOT + "SELECT * FROM wide",
    "per_query_pivot": _WIDE + "SELECT qid, " + ", ".join(f"round({c}, 6) AS {c}" for c in _COLUMN.values()) + " FROM wide",
    "win_tie_loss": _WIDE + "SELECT count(CASE WHEN round(bm25, 9) > round(dense, 9) THEN 1 END) AS wins, count(CASE WHEN round(bm25, 9) = round(dense, 9) THEN 1 END) AS ties, count(CASE WHEN round(bm25, 9) < round(dense, 9) THEN 1 END) AS losses FROM both_ran",
    "n_required": _with(QRELS, RUN, _WIDE_CTE, FUSED, _SPLIT["test"], _THREE, _ev("three", "q_test", "method", (10,), "te"),
        "m AS (SELECT round(avg(bm25), 4) AS bm25, round(avg(bge_small), 4) AS bge_small, round(avg(e5_small), 4) AS e5_small FROM wide)",
        "t AS (SELECT " + ", ".join(f"avg(CASE WHEN method = '{x}' THEN ndcg_10 END) AS {x.lower()}" for x in ("BM25", "Dense", "Hybrid")) + " FROM te)",
        "c AS (SELECT 'bge_small' AS a, 'bm25' AS b, bge_small - bm25 AS g FROM m UNION ALL SELECT 'bge_small', 'e5_small', bge_small - e5_small FROM m "
        "UNION ALL SELECT 'hybrid', 'dense', hybrid - dense FROM t UNION ALL SELECT 'dense', 'bm25', dense - bm25 FROM t)")
    + "SELECT a, b, round(g, 4) AS observed_gap, CASE WHEN abs(g) < 1e-12 THEN 1000000000 ELSE ceil(ln(2.0::DOUBLE / (1 - 0.95::DOUBLE)) / (2 * g * g)) END::BIGINT AS n_required FROM c",
    "index_memory": _with(CORPUS) + "SELECT count(*) AS n_docs, (count(*) * 384 * 4 // 1048576)::VARCHAR || ' MB (' || count(*)::VARCHAR || ' x 384 f32)' AS memory FROM corpus",
    "idf_table": _with(CORPUS, _IDF) + "SELECT term, df, round(idf, 6) AS idf FROM idf",
    "feat_tech": _with(CORPUS, QUERY, _IDF, _TECH) + "SELECT qid, round(tech, 6) AS tech FROM tech",
    "feat_vocab_gap": _with(CORPUS, QUERY, QRELS, _GAP) + "SELECT qid, round(gap, 6) AS gap FROM gap",
    "router_features": _with(CORPUS, QUERY, QRELS, RUN, _IDF, _TECH, _GAP, "b AS (SELECT qid, max(score) AS s FROM run WHERE method = 'BM25' GROUP BY 1)")
    + f"SELECT q.qid, round(gap, 6) AS gap, len({WORD.format('text')}) AS len, round(tech, 6) AS tech, {_QUESTION} AS is_question, round({_MED}, 6) AS med_share, round(coalesce(s, 0), 6) AS bm25_top1 FROM queries q JOIN gap ON q.qid = gap.qid JOIN tech ON q.qid = tech.qid LEFT JOIN b ON q.qid = b.qid",
    "spearman": _STUDY.rstrip() + ", l AS (" + " UNION ALL ".join(f"SELECT '{n}' AS relationship, round({x}, 9) AS x, round({y}, 9) AS y FROM study" for n, x, y in _SPEARMAN) + """),
k AS (SELECT relationship, rank() OVER (PARTITION BY relationship ORDER BY x) + (count(*) OVER (PARTITION BY relationship, x) - 1) / 2.0::DOUBLE AS rx, rank() OVER (PARTITION BY relationship ORDER BY y) + (count(*) OVER (PARTITION BY relationship, y) - 1) / 2.0::DOUBLE AS ry FROM l)
SELECT relationship, count(*) AS n, round(corr(rx, ry), 6) AS spearman_rho FROM k GROUP BY 1""",
    "wilcoxon": _WIDE.rstrip() + """, d AS (SELECT round(dense - bm25, 9) AS d FROM both_ran), nz AS (SELECT d, abs(d) AS s FROM d WHERE d <> 0),
k AS (SELECT d, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0::DOUBLE AS r, count(*) OVER (PARTITION BY s) AS t FROM nz),
a AS (SELECT count(*) AS n_nonzero, coalesce(sum(CASE WHEN d > 0 THEN r END), 0) AS w_plus, coalesce(sum(CASE WHEN d < 0 THEN r END), 0) AS w_minus, coalesce(sum(t * t - 1), 0)::DOUBLE AS tie_sum FROM k)
SELECT n_nonzero, w_plus, w_minus, least(w_plus, w_minus) AS w, tie_sum, (SELECT count(*) FROM d WHERE d > 0) AS a_wins, (SELECT count(*) FROM d WHERE d < 0) AS b_wins, (SELECT count(*) FROM d WHERE d = 0) AS ties FROM a""",
    "paired_bootstrap": _WIDE.rstrip() + f""", placed AS (SELECT dense - bm25 AS diff, row_number() OVER (ORDER BY qid) - 1 AS idx FROM both_ran),
{_draws(10000, "(SELECT count(*) FROM both_ran)", "(SELECT count(*) FROM both_ran)")},
boot AS (SELECT b, avg(diff) AS diff FROM draws JOIN placed ON draws.idx = placed.idx GROUP BY b)
SELECT round((SELECT avg(diff) FROM placed), 6) AS mean_diff, round(quantile_cont(diff, 0.025), 6) AS ci_lo, round(quantile_cont(diff, 0.975), 6) AS ci_hi, round(avg(CASE WHEN round(diff, 12) > 0 THEN 1 ELSE 0 END), 6) AS p_a_gt_b FROM boot""",
    "query_resampling": _RESAMPLED + "SELECT trial, " + ", ".join(f"round({c}, 6) AS {c}" for c in _TRIALS) + " FROM trials",
    "resampling_summary": _RESAMPLED + " UNION ALL ".join(f"SELECT '{c}' AS method, count(*) AS n_trials, round(avg({c}), 6) AS mean, round(quantile_cont({c}, 0.025), 6) AS q025, round(quantile_cont({c}, 0.975), 6) AS q975, round(stddev_samp({c}), 6) AS std, {_SIZE} AS subset_size FROM trials" for c in _TRIALS),
    "stratify_gap": _STUDY.rstrip() + _STRATA.replace("{by}", "gap"),
    "stratify_tech": _STUDY.rstrip() + _STRATA.replace("{by}", "tech"),
    "ols_delta": _STUDY.rstrip() + _ols(),
    "ols_bootstrap": _STUDY.rstrip() + _ols_bootstrap(10_000),
    "profile_collection": _with(CORPUS, QUERY, "l AS (SELECT 'documents' AS what, len(list_filter(string_split_regex(content, '\\s+'), lambda x: x <> '')) AS n FROM prep UNION ALL SELECT 'queries', len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) FROM queries)")
    + "SELECT what, count(*) AS n, round(avg(l.n), 6) AS mean, median(l.n)::DOUBLE AS median, min(l.n)::DOUBLE AS least, max(l.n)::DOUBLE AS most FROM l GROUP BY 1",
    "profile_judgements": _with(QRELS, "n AS (SELECT count(*) AS n FROM qrels GROUP BY qid)")
    + "SELECT count(*) AS n_queries, sum(n)::BIGINT AS n_judgements, round(avg(n), 6) AS mean, median(n)::DOUBLE AS median, max(n)::DOUBLE AS most FROM n",
    "profile_splits": _with(QUERY, QRELS)
    + "SELECT split, count(DISTINCT qid) AS n_judged, count(DISTINCT CASE WHEN qid IN (SELECT qid FROM queries) THEN qid END) AS n_queries, count(*) AS n_judgements FROM judged GROUP BY 1",
    "profile_query_histogram": _with(QUERY, "l AS (SELECT len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) AS n FROM queries)", "b AS (SELECT min(n)::DOUBLE AS lo, (max(n)::DOUBLE - min(n)) / 50 AS w FROM l)")
    + "SELECT least(floor((n - lo) / w), 49)::BIGINT AS bin, count(*) AS n FROM l, b GROUP BY 1",
    "profile_grades": _with(QRELS) + "SELECT rel::BIGINT AS rel, count(*) AS n, round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM qrels), 6) AS percent FROM qrels GROUP BY 1",
    "profile_histogram": _with(CORPUS, "l AS (SELECT len(list_filter(string_split_regex(content, '\\s+'), lambda x: x <> '')) AS n FROM prep)", "b AS (SELECT min(n)::DOUBLE AS lo, (max(n)::DOUBLE - min(n)) / 50 AS w FROM l)")
    + "SELECT least(floor((n - lo) / w), 49)::BIGINT AS bin, count(*) AS n FROM l, b GROUP BY 1",
    "profile_examples": _with(CORPUS, QUERY, QRELS, "f AS (SELECT qid FROM queries WHERE qid IN (SELECT qid FROM qrels) ORDER BY qid LIMIT 3)", "k AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rel DESC, doc_id) AS place FROM qrels WHERE qid IN (SELECT qid FROM f))")
    + "SELECT k.qid, place, k.doc_id, rel::BIGINT AS rel, coalesce(c.title, 'No title') AS title, substring(coalesce(c.text, ''), 1, 120) AS preview FROM k LEFT JOIN corpus c ON k.doc_id = c.doc_id WHERE place <= 2",
    "router_label": _STRATEGIES + "SELECT qid, (list_position([round(bm25, 9), round(bge, 9), round(hybrid, 9), round(medcpt, 9)], greatest(round(bm25, 9), round(bge, 9), round(hybrid, 9), round(medcpt, 9))) - 1)::BIGINT AS label FROM st",
    "router_oracle": _STRATEGIES + "SELECT round(avg(greatest(bm25, bge, hybrid, medcpt)), 6) AS value, count(*) AS n_queries FROM st",
    "router_policy_value": _with(QUERY, _STRATEGIES[5:].rstrip()) + f"SELECT round(avg(CASE WHEN len({WORD.format('text')}) >= 9 THEN bm25 ELSE hybrid END), 6) AS value, count(*) AS n_queries FROM st JOIN queries q ON st.qid = q.qid",
    "router_baselines": _STRATEGIES + " UNION ALL ".join(f"SELECT '{n}' AS method, round(avg({e}), 6) AS ndcg_10, round(1 - avg({e}), 6) AS risk FROM st" for n, e in [*((c, c) for c in ("bm25", "bge", "hybrid", "medcpt")), ("oracle", "greatest(bm25, bge, hybrid, medcpt)")]),
    "qa_contexts": _CTX + "SELECT qid, len(passages) AS n_passages, coalesce(array_to_string(passages, chr(10)), '') AS passages FROM ctx",
    "qa_prompt": _CTX + f"""SELECT qid, '{_HEAD}' || text || '{_MID}' || CASE WHEN coalesce(array_to_string(list_transform(passages, lambda p, i: '[' || i::VARCHAR || '] ' || p), chr(10)), '') = '' THEN '{NO_EVIDENCE}' ELSE array_to_string(list_transform(passages, lambda p, i: '[' || i::VARCHAR || '] ' || p), chr(10)) END || '{_TAIL}' AS prompt FROM ctx""",
    "qa_accuracy": _with(CORPUS, QUERY, QRELS, RUN, RANKED, _TOP5.format(m="BM25"), _TOP5.format(m="BGE-small").replace("ctx AS", "ctx2 AS"),
                         _LEX.replace("method = 'BM25'", "method = 'BGE-small'"), "lr AS (SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY round(score, 6) DESC, doc_id) AS rank FROM lex)",
                         """ctx3 AS (SELECT q.qid, q.text, 'reranked' AS method, coalesce(p.passages, []) AS passages FROM (SELECT * FROM queries WHERE qid IN (SELECT qid FROM qrels)) q
  LEFT JOIN (SELECT lr.qid, list(content ORDER BY rank) AS passages FROM lr JOIN prep ON lr.doc_id = prep.doc_id WHERE rank <= 5 GROUP BY lr.qid) p ON q.qid = p.qid)""",
                         "gold AS (SELECT q.qid, arg_max(text, (rel, c.doc_id)) AS t FROM qrels q JOIN corpus c ON q.doc_id = c.doc_id GROUP BY 1)",
                         f"""a AS (SELECT method, qid, CASE WHEN len(passages) = 0 THEN '{NO_EVIDENCE}' ELSE array_to_string(passages, chr(10)) END AS p
  FROM (SELECT * FROM ctx UNION ALL SELECT * FROM ctx2 UNION ALL SELECT * FROM ctx3 UNION ALL SELECT qid, text, 'none', [] FROM ctx))""")
    + f"SELECT method, count(*) AS n, round(avg(CASE WHEN {_ANSWER.format('p')} = {_ANSWER.format('t')} THEN 1 ELSE 0 END), 3) AS accuracy FROM a JOIN gold ON a.qid = gold.qid GROUP BY 1",
}
