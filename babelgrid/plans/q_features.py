"""Feature-preparation and span queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..functions.labels import UPOS_DEFAULT, UPOS_LABELS, WIKIANN_LABELS, decode_array, encode_or_default
from ..functions.text import first_answer, ner_prompt, pair_prompt, qa_prompt, tag_target
from ..operators import features as D
from ..operators.spans import best_spans, candidates, with_top_k
from ..operators.transfer import doc_tokens
from .registry import register
from .sqlfx import NER_LABELS_SQL, UPOS_SQL, strip, with_fx, words


def _vocab(spark, sf_dir):
    cls = fx.fx_cls(spark, sf_dir).filter(F.col("split") == "train")
    return D.build_vocab(cls.select(F.explode_outer(doc_tokens("text")).alias("token")).filter(F.col("token").isNotNull()))


_VOCAB_SQL = f"""
, vocab AS (SELECT token, cnt, CAST(3 + row_number() OVER (ORDER BY cnt DESC, token) AS INTEGER) AS token_id
            FROM (SELECT token, count(*) AS cnt
                  FROM (SELECT unnest({words('lower(text)')}) AS token FROM fx_cls WHERE split = 'train') GROUP BY ALL))"""


@register("vocabulary", with_fx(_VOCAB_SQL + "\nSELECT token, CAST(cnt AS BIGINT) AS cnt, token_id FROM vocab", "fx_cls"))
def vocabulary(spark, sf_dir):
    """Vocabulary of the engine tokenizer: ids by (count desc, token)."""
    return _vocab(spark, sf_dir).select("token", F.col("cnt").cast("long"), "token_id")


_ENC1_SQL = _VOCAB_SQL + f"""
, toks AS (SELECT id, unnest(range(len(w))) AS pos, unnest(w) AS token FROM (SELECT id, {words('lower(text)')} AS w FROM fx_cls)),
ntok AS (SELECT id, count(*) AS n FROM toks GROUP BY id),
enc AS (SELECT t.id, list(coalesce(v.token_id, 3) ORDER BY t.pos) AS ids FROM toks t LEFT JOIN vocab v USING (token) WHERE t.pos < 126 GROUP BY t.id),
body AS (SELECT c.id, CAST(coalesce(n.n, 0) AS INTEGER) AS n_tokens, [1] || coalesce(e.ids, []) || [2] AS body
         FROM fx_cls c LEFT JOIN enc e USING (id) LEFT JOIN ntok n USING (id))"""


@register("encode_single", with_fx(_ENC1_SQL + """
SELECT id, n_tokens, CAST(len(body) AS INTEGER) AS attention, array_to_string(list_resize(body, 128, 0), ' ') AS input_ids FROM body""",
                                   "fx_cls"))
def encode_single(spark, sf_dir):
    """Single text, truncated to 128 and padded."""
    e = D.encode_single(fx.fx_cls(spark, sf_dir), _vocab(spark, sf_dir))
    return e.select("id", F.col("n_tokens").cast("int"), F.col("attention").cast("int"), F.array_join("input_ids", " ").alias("input_ids"))


@register("decode_ids", with_fx(_ENC1_SQL + """
, flat AS (SELECT id, unnest(range(len(body))) AS pos, unnest(body) AS tid FROM body)
SELECT b.id, coalesce(d.text, '') AS text FROM body b LEFT JOIN
  (SELECT f.id, string_agg(v.token, ' ' ORDER BY f.pos) AS text FROM flat f JOIN vocab v ON v.token_id = f.tid GROUP BY f.id) d USING (id)""",
                                "fx_cls"))
def decode_ids(spark, sf_dir):
    """Decode the D1 ids back to text; specials and unknowns skipped."""
    vocab = _vocab(spark, sf_dir)
    e = D.encode_single(fx.fx_cls(spark, sf_dir), vocab)
    return D.decode_ids(e, vocab).select("id", "text")


@register("encode_pair", with_fx(_VOCAB_SQL + f"""
, lens AS (SELECT id, len({words('lower(premise)')}) AS la, len({words('lower(hypothesis)')}) AS lb FROM fx_pair),
keep AS (SELECT id, CAST(CASE WHEN la + lb <= 252 THEN la ELSE least(la, greatest(252 - lb, 126)) END AS INTEGER) AS ka, la, lb FROM lens),
keep2 AS (SELECT id, ka, CAST(CASE WHEN la + lb <= 252 THEN lb ELSE 252 - ka END AS INTEGER) AS kb FROM keep),
ta AS (SELECT id, unnest(range(len(w))) AS pos, unnest(w) AS token FROM (SELECT id, {words('lower(premise)')} AS w FROM fx_pair)),
tb AS (SELECT id, unnest(range(len(w))) AS pos, unnest(w) AS token FROM (SELECT id, {words('lower(hypothesis)')} AS w FROM fx_pair)),
ia AS (SELECT t.id, list(coalesce(v.token_id, 3) ORDER BY t.pos) AS ids FROM ta t JOIN keep2 k USING (id) LEFT JOIN vocab v USING (token) WHERE t.pos < k.ka GROUP BY t.id),
ib AS (SELECT t.id, list(coalesce(v.token_id, 3) ORDER BY t.pos) AS ids FROM tb t JOIN keep2 k USING (id) LEFT JOIN vocab v USING (token) WHERE t.pos < k.kb GROUP BY t.id)
SELECT k.id, k.ka AS len_a, k.kb AS len_b,
       array_to_string([1] || coalesce(ia.ids, []) || [2, 2] || coalesce(ib.ids, []) || [2], ' ') AS input_ids
FROM keep2 k LEFT JOIN ia USING (id) LEFT JOIN ib USING (id)""", "fx_cls", "fx_pair"))
def encode_pair(spark, sf_dir):
    """Premise / hypothesis pair, longest-first truncation to 256."""
    e = D.encode_pair(fx.fx_pair(spark, sf_dir), _vocab(spark, sf_dir))
    return e.select("id", F.col("len_a").cast("int"), F.col("len_b").cast("int"), F.array_join("input_ids", " ").alias("input_ids"))


def _t2t_sql(src: str, target_max: int, *names: str) -> str:
    """``src``: a query of (id, s, t), source and target texts."""
    return with_fx(_VOCAB_SQL + f"""
, src AS ({src}),
ts AS (SELECT id, unnest(range(len(w))) AS pos, unnest(w) AS token FROM (SELECT id, {words('lower(s)')} AS w FROM src)),
tt AS (SELECT id, unnest(range(len(w))) AS pos, unnest(w) AS token FROM (SELECT id, {words('lower(t)')} AS w FROM src)),
i1 AS (SELECT t.id, list(coalesce(v.token_id, 3) ORDER BY t.pos) AS ids FROM ts t LEFT JOIN vocab v USING (token) WHERE t.pos < {D.T2T_INPUT_MAX - 1} GROUP BY t.id),
i2 AS (SELECT t.id, list(coalesce(v.token_id, 3) ORDER BY t.pos) AS ids FROM tt t LEFT JOIN vocab v USING (token) WHERE t.pos < {target_max - 1} GROUP BY t.id)
SELECT s.id, array_to_string(coalesce(i1.ids, []) || [2], ' ') AS input_ids, array_to_string(coalesce(i2.ids, []) || [2], ' ') AS labels
FROM src s LEFT JOIN i1 USING (id) LEFT JOIN i2 USING (id)""", "fx_cls", *names)


def _t2t(e):
    return e.select("id", F.array_join("input_ids", " ").alias("input_ids"), F.array_join("labels", " ").alias("labels"))


@register("encode_text2text", _t2t_sql(f"""
SELECT id, 'question: ' || {strip('question')} || '  context: ' || context AS s, coalesce(answers.text[1], '') AS t FROM fx_qa""",
                                       D.T2T_TARGET_MAX, "fx_qa"))
def encode_text2text(spark, sf_dir):
    """D3 (+C2, C5): QA prompt -> input ids (cap 1024), first answer -> labels (cap 128)."""
    q = fx.fx_qa(spark, sf_dir).select("task", "lang", "id", qa_prompt("question", "context").alias("src"), first_answer("answers").alias("tgt"))
    return _t2t(D.encode_text2text(q, _vocab(spark, sf_dir), "src", "tgt"))


@register("encode_text2text_tags", _t2t_sql(f"""
SELECT s.id, 'ner: ' || array_to_string(s.tokens, ' ') AS s,
       coalesce(nullif(string_agg({NER_LABELS_SQL}[t.tag + 1], ' ' ORDER BY t.pos) FILTER (WHERE t.tag <> 0), ''), 'None') AS t
FROM fx_sent s LEFT JOIN fx_ner_tok t ON t.id = s.id GROUP BY s.id, s.tokens""", D.TAG_TARGET_MAX, "fx_sent", "fx_ner_tok"))
def encode_text2text_tags(spark, sf_dir):
    """D3 (+C4, C6): tagging prompt -> input ids, entity tags -> labels (cap 32)."""
    n = fx.fx_ner(spark, sf_dir).select("task", "lang", "id", ner_prompt("tokens").alias("src"),
                                        tag_target(decode_array("tags", WIKIANN_LABELS)).alias("tgt"))
    return _t2t(D.encode_text2text(n, _vocab(spark, sf_dir), "src", "tgt", target_max=D.TAG_TARGET_MAX))


@register("encode_text2text_pairs", _t2t_sql("""
SELECT id, 'xnli: premise: ' || premise || ' hypothesis: ' || hypothesis AS s, hypothesis AS t FROM fx_pair""", D.CLASS_TARGET_MAX, "fx_pair"))
def encode_text2text_pairs(spark, sf_dir):
    """D3 (+C3): pair prompt -> input ids, a text longer than the cap -> labels (cap 8)."""
    p = fx.fx_pair(spark, sf_dir).select("task", "lang", "id", pair_prompt("premise", "hypothesis").alias("src"), F.col("hypothesis").alias("tgt"))
    return _t2t(D.encode_text2text(p, _vocab(spark, sf_dir), "src", "tgt", target_max=D.CLASS_TARGET_MAX))


# --- D4-D7 ------------------------------------------------------------------------

_QA_FEAT_SQL = f"""
, ex AS (SELECT id, len({words(strip('question'))}) AS qlen, len({words('context')}) AS n,
                answers.answer_start[1] AS sc, answers.answer_start[1] + length(answers.text[1]) AS ec FROM fx_qa),
ex2 AS (SELECT *, 384 - qlen - 4 AS cap, 384 - qlen - 4 - 128 AS step FROM ex),
ex3 AS (SELECT *, CAST(greatest(0, ceil((n - cap) / step)) AS INTEGER) + 1 AS nwin FROM ex2),
tok AS (SELECT id, tok, s, s + length(w) AS e FROM (
          SELECT id, pos AS tok, w, coalesce(sum(length(w) + 1) OVER (PARTITION BY id ORDER BY pos
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s
          FROM (SELECT id, unnest(range(len(ws))) AS pos, unnest(ws) AS w FROM (SELECT id, {words('context')} AS ws FROM fx_qa)))),
win AS (SELECT id, qlen, sc, ec, k AS feature_idx, k * step AS tok_start, least(k * step + cap, n) AS tok_end
        FROM (SELECT *, unnest(range(nwin)) AS k FROM ex3)),
wf AS (SELECT w.id, w.feature_idx, w.tok_start, w.tok_end, w.qlen, w.sc, w.ec,
              min(t.s) AS first_s, max(t.e) AS last_e,
              count(*) FILTER (WHERE t.s <= w.sc) AS n_le, count(*) FILTER (WHERE t.e < w.ec) AS n_lt,
              string_agg(CAST(t.s AS VARCHAR) || ':' || CAST(t.e AS VARCHAR), ',' ORDER BY t.tok) AS offs
       FROM win w JOIN tok t ON t.id = w.id AND t.tok >= w.tok_start AND t.tok < w.tok_end
       GROUP BY ALL)"""


def _qa_windows(spark, sf_dir):
    return D.qa_windows(fx.fx_qa(spark, sf_dir))


@register("qa_windows", with_fx(_QA_FEAT_SQL + """
SELECT id, CAST(feature_idx AS INTEGER) AS feature_idx, CAST(tok_start AS INTEGER) AS tok_start, CAST(tok_end AS INTEGER) AS tok_end,
       CAST(qlen + 3 + tok_end - tok_start + 1 AS INTEGER) AS seq_len FROM wf""", "fx_qa"))
def qa_windows(spark, sf_dir):
    """D4 + D5: strided windows (384 total, 128 overlap), window -> example."""
    return _qa_windows(spark, sf_dir).select("id", "feature_idx", "tok_start", "tok_end", "seq_len")


@register("qa_offset_mask", with_fx(_QA_FEAT_SQL + """
SELECT id, CAST(feature_idx AS INTEGER) AS feature_idx, repeat('N,', CAST(qlen + 3 AS INTEGER)) || offs || ',N' AS offsets FROM wf""", "fx_qa"))
def qa_offset_mask(spark, sf_dir):
    """Per-position offsets, null (N) outside the context."""
    f = D.qa_offsets(fx.fx_qa(spark, sf_dir))
    s = F.array_join(F.transform("offsets", lambda o: F.coalesce(F.concat(o["s"].cast("string"), F.lit(":"), o["e"].cast("string")), F.lit("N"))), ",")
    return f.select("id", "feature_idx", s.alias("offsets"))


@register("qa_token_span", with_fx(_QA_FEAT_SQL + """
SELECT id, CAST(feature_idx AS INTEGER) AS feature_idx,
       CAST(CASE WHEN sc IS NOT NULL AND first_s <= sc AND last_e >= ec THEN qlen + 3 + n_le - 1 ELSE 0 END AS INTEGER) AS start_position,
       CAST(CASE WHEN sc IS NOT NULL AND first_s <= sc AND last_e >= ec THEN qlen + 3 + n_lt ELSE 0 END AS INTEGER) AS end_position
FROM wf""", "fx_qa"))
def qa_token_span(spark, sf_dir):
    """Answer character span -> token span per window, (0, 0) outside."""
    return _qa_windows(spark, sf_dir).select("id", "feature_idx", "start_position", "end_position")


# --- D8 / D9 ------------------------------------------------------------------------

def _word_ids(tokens: str, cap: int | None = None):
    """Word id of every sub-word piece: 1 + len(word) div 4 pieces per word
    (the fixture's stand-in for a sub-word tokenizer), specials as null."""
    pieces = F.flatten(F.transform(tokens, lambda w, i: F.array_repeat(i, 1 + F.floor(F.length(w) / 4).cast("int"))))
    none = F.array(F.lit(None).cast("int"))
    if cap is None:
        return F.concat(none, pieces, none)
    body = F.concat(none, F.slice(pieces, 1, cap - 2), none)
    return F.concat(body, F.array_repeat(F.lit(None).cast("int"), F.lit(cap) - F.size(body)))


@register("align_labels", with_fx("""
, pieces AS (SELECT id, pos, tag, unnest(range(1 + length(tok) // 4)) AS piece FROM fx_ner_tok)
SELECT id, '-100 ' || string_agg(CAST(CASE WHEN piece = 0 THEN tag ELSE -100 END AS VARCHAR), ' ' ORDER BY pos, piece) || ' -100' AS labels
FROM pieces GROUP BY id""", "fx_ner_tok"))
def align_labels(spark, sf_dir):
    """First piece of a word gets its label, other pieces and specials -100."""
    n = fx.fx_ner(spark, sf_dir).select("id", "tags", _word_ids("tokens").alias("wid"))
    return n.select("id", F.array_join(D.align_labels(F.col("wid"), F.col("tags")), " ").alias("labels"))


@register("align_labels_guarded", with_fx(f"""
, pieces AS (SELECT id, pos, upos, unnest(range(1 + length(tok) // 4)) AS piece FROM fx_pos_tok),
seq AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY pos, piece) AS k,
               CASE WHEN piece = 0 THEN coalesce(list_position({UPOS_SQL}, upos) - 1, 16) ELSE -100 END AS lab FROM pieces),
kept AS (SELECT id, string_agg(CAST(lab AS VARCHAR), ' ' ORDER BY k) AS body, count(*) AS n FROM seq WHERE k <= 254 GROUP BY id)
SELECT id, '-100 ' || body || repeat(' -100', CAST(256 - n - 1 AS INTEGER)) AS labels FROM kept""", "fx_pos_tok"))
def align_labels_guarded(spark, sf_dir):
    """As D8 on 256 pieces (truncated, padded), unknown tag -> X, word ids
    beyond the label array ignored."""
    p = fx.fx_pos(spark, sf_dir).select("id", "upos", _word_ids("tokens", 256).alias("wid"))
    ids = F.transform("upos", lambda t: encode_or_default(t, UPOS_LABELS, UPOS_DEFAULT))
    p = p.select("id", "wid", ids.alias("uid"))
    return p.select("id", F.array_join(D.align_labels(F.col("wid"), F.col("uid"), guarded=True), " ").alias("labels"))


# --- G1 / F3 / G3 ------------------------------------------------------------------------

_TOPK_SQL = """
, sv AS (SELECT id, feature_idx, unnest(range(len(start_logit))) AS pos, unnest(start_logit) AS v FROM fx_span),
ev AS (SELECT id, feature_idx, unnest(range(len(end_logit))) AS pos, unnest(end_logit) AS v FROM fx_span),
st AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id, feature_idx ORDER BY v DESC, pos DESC) AS rn FROM sv) WHERE rn <= 20),
en AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id, feature_idx ORDER BY v DESC, pos DESC) AS rn FROM ev) WHERE rn <= 20)"""

_CAND_SQL = _TOPK_SQL + """,
cand AS (SELECT s.id, s.feature_idx, s.pos AS s, e.pos AS e, s.v AS sl, e.v AS el, s.v + e.v AS score,
                f.offsets[s.pos + 1].s AS start_char, f.offsets[e.pos + 1].e AS end_char, f.context
         FROM st s JOIN en e ON s.id = e.id AND s.feature_idx = e.feature_idx
         JOIN fx_span f ON f.id = s.id AND f.feature_idx = s.feature_idx
         WHERE f.offsets[s.pos + 1] IS NOT NULL AND f.offsets[e.pos + 1] IS NOT NULL
           AND e.pos >= s.pos AND e.pos - s.pos <= 30 AND s.v + e.v > -1e9)"""


@register("top20_positions", with_fx(_TOPK_SQL + """
SELECT s.id, s.feature_idx, s.top_start, e.top_end FROM
  (SELECT id, feature_idx, string_agg(CAST(pos AS VARCHAR), ' ' ORDER BY rn) AS top_start FROM st GROUP BY ALL) s
  JOIN (SELECT id, feature_idx, string_agg(CAST(pos AS VARCHAR), ' ' ORDER BY rn) AS top_end FROM en GROUP BY ALL) e
  USING (id, feature_idx)""", "fx_span"))
def top20_positions(spark, sf_dir):
    """G1: top-20 start and end positions per window, largest first."""
    w = with_top_k(fx.fx_span(spark, sf_dir))
    return w.select("id", "feature_idx", F.array_join("top_start", " ").alias("top_start"), F.array_join("top_end", " ").alias("top_end"))


@register("span_candidates", with_fx(_CAND_SQL + """
SELECT f.id, f.feature_idx, CAST(count(c.s) AS INTEGER) AS n_candidates, round(CAST(max(c.score) AS DOUBLE), 5) AS best_score
FROM fx_span f LEFT JOIN cand c ON c.id = f.id AND c.feature_idx = f.feature_idx GROUP BY ALL""", "fx_span"))
def span_candidates(spark, sf_dir):
    """F2 + F3: valid (start, end) candidates per window and the best score."""
    w = with_top_k(fx.fx_span(spark, sf_dir)).withColumn("cand", candidates())
    return w.select("id", "feature_idx", F.size("cand").alias("n_candidates"),
                    F.round(F.array_max(F.transform("cand", lambda c: c["score"])).cast("double"), 5).alias("best_score"))


@register("best_span", with_fx(_CAND_SQL + """
, best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, feature_idx, sl, el, s, e) AS rn FROM cand) WHERE rn = 1)
SELECT i.id, coalesce(substring(b.context, b.start_char + 1, b.end_char - b.start_char), '') AS pred_text,
       round(CAST(b.score AS DOUBLE), 5) AS score
FROM (SELECT DISTINCT id FROM fx_span) i LEFT JOIN best b USING (id)""", "fx_span"))
def best_span(spark, sf_dir):
    """G3 + C10: best answer text per example over all its windows."""
    b = best_spans(fx.fx_span(spark, sf_dir), [])
    return b.select("id", "pred_text", F.round("score", 5).alias("score"))
