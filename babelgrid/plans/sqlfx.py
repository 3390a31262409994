"""SQL twins (DuckDB dialect) of the fixture rules in ``babelgrid.fixtures``.

The oracle queries are written independently of the Spark plans: where the
Spark side uses higher-order functions on arrays, the SQL side mostly unnests
and uses window functions.  ``with_fx`` assembles the CTEs a query needs.
"""

from __future__ import annotations

from ..functions.labels import MASAKHANER_LABELS, UPOS_LABELS, WIKIANN_LABELS
from ..functions.text import WS_CLASS


def words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '{WS_CLASS}+'), lambda t: t <> '')"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS_CLASS}+|{WS_CLASS}+$', '', 'g')"


SPLIT = "CASE WHEN {d} % 10 < 7 THEN 'train' WHEN {d} % 10 = 7 THEN 'validation' ELSE 'test' END"

NER_LABELS_SQL, NER9_LABELS_SQL, UPOS_SQL = str(WIKIANN_LABELS), str(MASAKHANER_LABELS), str(UPOS_LABELS)


def _hex(ch: str) -> str:
    return f"(strpos('0123456789abcdef', {ch}) - 1)"


def _ner_tok(labels: str, more: str = "") -> str:
    return f"""
        SELECT doc_id, line, lang, id, pos, tok,
               CASE WHEN typ = 'O' THEN 0
                    ELSE list_position({labels},
                         CASE WHEN pos = 0 OR prev_typ <> typ THEN 'B-' ELSE 'I-' END || typ) - 1 END AS tag
        FROM (SELECT *, lag(typ) OVER (PARTITION BY id ORDER BY pos) AS prev_typ
              FROM (SELECT *, CASE substr(md5(tok), 1, 1) WHEN '0' THEN 'PER' WHEN '1' THEN 'PER'
                                   WHEN '2' THEN 'ORG' WHEN '3' THEN 'LOC' {more} ELSE 'O' END AS typ
                    FROM (SELECT doc_id, line, lang, id, unnest(range(len(tokens))) AS pos, unnest(tokens) AS tok FROM fx_sent)))"""


def _ner_pred(tok: str) -> str:
    return f"""
        SELECT t.transfer_lang, n.lang AS task_lang, n.id, n.line, n.pos, n.tok, n.tag,
               CASE WHEN n.pos % 7 = 6 THEN -100 ELSE n.tag END AS label,
               CASE WHEN (n.doc_id * 31 + n.line * 17 + ascii(t.transfer_lang) * 13 + n.pos * 7) % 16
                         < CASE WHEN t.transfer_lang = n.lang THEN 1 ELSE 3 END THEN 0 ELSE n.tag END AS pred
        FROM {tok} n CROSS JOIN fx_ner_langs t"""


FX: dict[str, tuple[list[str], str]] = {
    "fx_cls": ([], f"""
        SELECT 'cls' AS task, d.lang, {SPLIT.format(d='d.doc_id')} AS split,
               CAST(d.doc_id AS VARCHAR) AS id, d.doc_id, d.text,
               CAST(l.quality * 2 + l.toxic AS INTEGER) AS label
        FROM documents d JOIN labels l ON d.doc_id = l.doc_id"""),
    "fx_cls_langs": (["fx_cls"], "SELECT DISTINCT task, lang AS transfer_lang FROM fx_cls WHERE split = 'train'"),
    "fx_pred": (["fx_cls", "fx_cls_langs"], """
        SELECT c.task, 'fixture' AS model, t.transfer_lang, c.lang AS task_lang, c.id, c.doc_id, c.label,
               CAST(CASE WHEN substr(md5(t.transfer_lang || ':' || c.id), 1, 1)
                              < CASE WHEN t.transfer_lang = c.lang THEN 'e' ELSE 'b' END
                         THEN c.label ELSE (c.label + 1) % 4 END AS INTEGER) AS pred
        FROM fx_cls c JOIN fx_cls_langs t ON c.task = t.task
        WHERE c.split = 'test'"""),
    "fx_logits": ([], "SELECT vec_id AS id, embedding AS logits, CAST(label AS INTEGER) AS label FROM embeddings"),
    "fx_qa_w": ([], f"SELECT doc_id, lang, {words('text')} AS words FROM documents"),
    "fx_qa": (["fx_qa_w"], """
        SELECT 'qa' AS task, lang, 'validation' AS split, lang || '-' || CAST(doc_id AS VARCHAR) AS id, doc_id,
               array_to_string(words[1:5], ' ') || '?' AS question,
               array_to_string(words, ' ') AS context,
               CASE WHEN doc_id % 10 <> 9 AND len(words) > 0
                    THEN {'text': [array_to_string(words[a + 1:a + 3], ' ')],
                          'answer_start': [CAST(CASE WHEN a = 0 THEN 0 ELSE length(array_to_string(words[1:a], ' ')) + 1 END AS INTEGER)]}
                    ELSE {'text': []::VARCHAR[], 'answer_start': []::INTEGER[]} END AS answers
        FROM (SELECT *, CAST(doc_id % greatest(len(words) - 3, 1) AS INTEGER) AS a FROM fx_qa_w)"""),
    "fx_qa_langs": (["fx_qa"], "SELECT DISTINCT task, lang AS transfer_lang FROM fx_qa"),
    "fx_qapred": (["fx_qa", "fx_qa_langs"], """
        SELECT q.task, 'fixture' AS model, t.transfer_lang, q.lang AS task_lang, q.id, s.seq,
               CASE WHEN s.seq = 0 THEN 'none'
                    ELSE CASE (q.doc_id + ascii(t.transfer_lang)) % 4
                         WHEN 0 THEN q.ans
                         WHEN 1 THEN array_to_string(string_split(q.ans, ' ')[1:2], ' ')
                         WHEN 2 THEN 'the ' || q.ans || '.'
                         ELSE q.question END END AS pred_text
        FROM (SELECT *, coalesce(answers.text[1], '') AS ans FROM fx_qa WHERE doc_id % 10 <> 9 AND doc_id % 17 <> 0) q
        JOIN fx_qa_langs t ON q.task = t.task
        CROSS JOIN (VALUES (0), (1)) s(seq)"""),
    "fx_span": ([], """
        SELECT 'und' AS transfer_lang, 'ex' || CAST(vec_id % 100 AS VARCHAR) AS id,
               CAST(vec_id // 100 AS INTEGER) AS feature_idx,
               embedding AS start_logit, list_reverse(embedding) AS end_logit,
               list_transform(range(0, len(embedding)),
                   lambda p: CASE WHEN p >= 8 THEN {'s': CAST((p - 8) * 5 AS INTEGER), 'e': CAST((p - 8) * 5 + 4 AS INTEGER)} END) AS offsets,
               array_to_string(list_transform(range(8, len(embedding)), lambda p: 'w' || lpad(CAST(p AS VARCHAR), 3, '0')), ' ') AS context
        FROM embeddings"""),
    "fx_lines": ([], """
        SELECT doc_id, lang, unnest(range(len(parts))) AS line, unnest(parts) AS line_text
        FROM (SELECT doc_id, lang, string_split(text, chr(10)) AS parts FROM documents)"""),
    "fx_sent": (["fx_lines"], f"""
        SELECT doc_id, lang, line, CAST(doc_id AS VARCHAR) || ':' || CAST(line AS VARCHAR) AS id, toks AS tokens
        FROM (SELECT *, {words('line_text')} AS toks FROM fx_lines) WHERE len(toks) > 0"""),
    "fx_ner_tok": (["fx_sent"], _ner_tok(NER_LABELS_SQL)),
    "fx_ner9_tok": (["fx_sent"], _ner_tok(NER9_LABELS_SQL, "WHEN '4' THEN 'DATE'")),
    "fx_ner_langs": (["fx_sent"], "SELECT DISTINCT lang AS transfer_lang FROM fx_sent"),
    "fx_ner_pred_tok": (["fx_ner_tok", "fx_ner_langs"], _ner_pred("fx_ner_tok")),
    "fx_ner9_pred_tok": (["fx_ner9_tok", "fx_ner_langs"], _ner_pred("fx_ner9_tok")),
    "fx_pos_tok": (["fx_sent"], f"""
        SELECT doc_id, line, lang, id, pos, tok,
               coalesce({UPOS_SQL}[((({_hex('substr(md5(tok), 1, 1)')}) * 16 + {_hex('substr(md5(tok), 2, 1)')}) % 19) + 1], 'UNK') AS upos
        FROM (SELECT doc_id, line, lang, id, unnest(range(len(tokens))) AS pos, unnest(tokens) AS tok FROM fx_sent)"""),
    "fx_pos_langs": (["fx_sent"], "SELECT DISTINCT lang AS transfer_lang FROM fx_sent"),
    "fx_pos_pred_tok": (["fx_pos_tok", "fx_pos_langs"], f"""
        SELECT t.transfer_lang, p.lang AS task_lang, p.id, p.pos,
               CASE WHEN p.pos % 7 = 6 THEN -100 ELSE p.uid END AS label,
               CASE WHEN (p.doc_id * 31 + p.line * 17 + ascii(t.transfer_lang) * 13 + p.pos * 7) % 16
                         < CASE WHEN t.transfer_lang = p.lang THEN 1 ELSE 3 END THEN (p.uid + 1) % 18 ELSE p.uid END AS pred
        FROM (SELECT *, CAST(coalesce(list_position({UPOS_SQL}, upos) - 1, 16) AS INTEGER) AS uid FROM fx_pos_tok) p
        CROSS JOIN fx_pos_langs t"""),
    "fx_pair": ([], """
        SELECT 'pair' AS task, 'und' AS lang, 'test' AS split,
               CAST(a.conv_id AS VARCHAR) || ':' || CAST(a.turn AS VARCHAR) AS id,
               a.text AS premise, b.text AS hypothesis, CAST(a.turn % 3 AS INTEGER) AS label
        FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1"""),
    "fx_runs": ([], """
        SELECT CAST(user_id AS VARCHAR) AS run,
               CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS step,
               CAST(value AS DOUBLE) AS metric
        FROM events"""),
}


def with_fx(body: str, *names: str) -> str:
    """``WITH`` clause holding the named fixtures (and what they need) + body."""
    order: list[str] = []

    def add(n: str) -> None:
        if n in order:
            return
        for dep in FX[n][0]:
            add(dep)
        order.append(n)

    for n in names:
        add(n)
    if not order:
        return body
    ctes = ",\n".join(f"{n} AS ({FX[n][1]}\n)" for n in order)
    # a body starting with a comma continues the CTE list
    return f"WITH {ctes}\n{body.lstrip()}"


def cls_metrics_sql(src: str, cell: list[str], truth: str = "label", pred: str = "pred") -> str:
    """Accuracy, macro F1, weighted F1 and n per cell, from a class-union
    table joined to per-class counts (independent of the Spark plan)."""
    c = ", ".join(cell)
    using = ", ".join(cell + ["cls"])
    return f"""(
    WITH u AS (SELECT {c}, {truth} AS cls FROM {src} UNION SELECT {c}, {pred} AS cls FROM {src}),
         tp AS (SELECT {c}, {truth} AS cls, count(*) AS tp FROM {src} WHERE {truth} = {pred} GROUP BY ALL),
         sup AS (SELECT {c}, {truth} AS cls, count(*) AS sup FROM {src} GROUP BY ALL),
         np AS (SELECT {c}, {pred} AS cls, count(*) AS np FROM {src} GROUP BY ALL),
         k AS (SELECT {c}, cls, coalesce(tp, 0) AS tp, coalesce(sup, 0) AS sup, coalesce(np, 0) AS np
               FROM u LEFT JOIN tp USING ({using}) LEFT JOIN sup USING ({using}) LEFT JOIN np USING ({using})),
         f AS (SELECT {c}, tp, sup, CASE WHEN sup + np > 0 THEN 2.0 * tp / (sup + np) ELSE 0.0 END AS f1 FROM k)
    SELECT {c}, round(sum(tp) / sum(sup), 6) AS accuracy, round(avg(f1), 6) AS f1_score,
           round(sum(f1 * sup) / sum(sup), 6) AS weighted_f1, CAST(sum(sup) AS BIGINT) AS n
    FROM f GROUP BY {c})"""
