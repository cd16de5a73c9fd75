r"""ANSI SQL (DuckDB dialect) equivalents of the catalogue, each over whole tables.

RE2 writes the shared character classes its own way (``\s`` lacks ``\v``; ``\x{..}`` for code points).
"""

from __future__ import annotations

from pairloom.plans.catalog import DECOMPOSED, FOLD, LATIN_GROUPS, LATIN_VARIANTS, VOCAB

WS = r"\s\x0b\p{Z}\x1c-\x1f\x{85}"
WORD = r"\p{L}\p{N}_"
PUNCT = r"!-/:-@\[-`{-~"
ARABIC = r"\x{600}-\x{6FF}\x{750}-\x{77F}\x{8A0}-\x{8FF}"


def _q(text: str) -> str:
    return text.replace("'", "''")


def _re_strip(expr: str) -> str:
    return f"regexp_replace({expr}, '^[{WS}]+|[{WS}]+$', '', 'g')"


def _drop_ws(expr: str) -> str:
    return f"regexp_replace({expr}, '[{WS}]+', '', 'g')"


def _tokens(expr: str) -> str:
    return f"regexp_extract_all(lower({expr}), '[{WORD}]+|[^{WORD}{WS}]')"


def _respelled(expr: str) -> str:
    return f"replace(replace({expr}, 'ou', 'u'), ' and ', ' ')"


def _fold(expr: str, mapping: dict[str, str]) -> str:
    return f"translate({expr}, '{''.join(mapping)}', '{''.join(mapping.values())}')"


def _decomposed(expr: str) -> str:
    for whole, parts in DECOMPOSED.items():
        marks = "||".join(f"chr({ord(c)})" for c in parts)
        expr = f"replace({expr}, '{whole}', {marks})"
    return expr


def _chrf_words(expr: str) -> str:
    word_list = f"regexp_extract_all({expr}, '[^{WS}]+')"
    return f"""flatten(list_transform({word_list}, lambda w: CASE
        WHEN length(w) = 1 THEN [w]
        WHEN regexp_matches(right(w, 1), '[{PUNCT}]') THEN [left(w, -1), right(w, 1)]
        WHEN regexp_matches(left(w, 1), '[{PUNCT}]') THEN [left(w, 1), substr(w, 2)]
        ELSE [w] END))"""


def _bleu_tokens(expr: str) -> str:
    out = f"regexp_replace({expr}, '[{WS}]+$', '')"
    for old, new in (("'<skipped>'", "''"), ("'-' || chr(10)", "''"), ("chr(10)", "' '"), ("'&quot;'", "'\"'"),
                     ("'&amp;'", "'&'"), ("'&lt;'", "'<'"), ("'&gt;'", "'>'")):
        out = f"replace({out}, {old}, {new})"
    out = f"' ' || {out} || ' '"
    for pattern, new in ((r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", r" \1 "), (r"([^0-9])([\.,])", r"\1 \2 "),
                         (r"([\.,])([^0-9])", r" \1 \2"), (r"([0-9])(-)", r"\1 \2 ")):
        out = f"regexp_replace({out}, '{pattern}', '{new}', 'g')"
    return f"regexp_extract_all({out}, '[^{WS}]+')"


NOISY = f"SELECT doc_id AS id, lang, {_respelled('text')} AS hyp, text AS ref FROM documents"
PAIRS = """SELECT a.conv_id || ':' || a.turn AS id, a.text AS hyp, b.text AS ref
    FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1"""
CHARS = "SELECT unnest(string_split(text, '')) AS ch, lang FROM documents"
COUNTS = f"SELECT ch, count(*) AS n, 100.0 * count(*) / sum(count(*)) OVER () AS pct FROM ({CHARS}) GROUP BY ch"
GROUPS = "VALUES " + ", ".join(
    f"({g}, '{ch}', {o})" for g, group in enumerate(LATIN_GROUPS, start=1) for o, ch in enumerate(group)
)
SPLIT_OF = """CASE WHEN b < 100000 THEN 'test' WHEN b < 200000 THEN 'val' ELSE 'train' END"""


def _hash_split(key: str, columns: str) -> str:
    bucket = f"('0x' || substr(md5({key} || '#42'), 1, 8))::BIGINT % 1000000"
    return f"SELECT {columns}, {SPLIT_OF} AS split FROM (SELECT *, {bucket} AS b FROM documents)"


def _learned(counts: str, threshold: float) -> str:
    return f"""SELECT from_ch, arg_max(to_ch, group_id) AS to_ch FROM (
        SELECT group_id, ch AS from_ch, first_value(ch) OVER g AS to_ch,
               first_value(n) OVER g AS main_n, sum(n) OVER (PARTITION BY group_id) AS total
        FROM ({counts}) JOIN ({GROUPS}) v(group_id, ch, ord) USING (ch)
        WINDOW g AS (PARTITION BY group_id ORDER BY n DESC, ord))
        WHERE from_ch <> to_ch AND main_n / total >= {threshold} GROUP BY from_ch"""


def _wide(name: str, seq: str, keys: str, orders: int) -> str:
    """CTE ``name``: at every position of a list column, the n-grams g1..gN that start there (null past the end)."""
    grams, gram = [], "s"
    for n in range(1, orders + 1):
        grams.append(f"{gram} AS g{n}")
        gram += f" || chr(31) || lead(s, {n}) OVER w"
    return f"""{name} AS (SELECT {keys}, {', '.join(grams)} FROM (
        SELECT {keys}, unnest({seq}) AS s, generate_subscripts({seq}, 1) AS p FROM seqs) WHERE s <> ''
        WINDOW w AS (PARTITION BY {keys} ORDER BY p))"""


def _long(name: str, keys: str, labels: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT {keys}, {label} AS ord, g{n} AS gram FROM {name} WHERE g{n} IS NOT NULL"
        for n, label in enumerate(labels, start=1)
    )


def _gram_stats(view: str, kind: str) -> str:
    """CTEs ending in ``stats(id, ord, h, r, m)``; pairs without n-grams of an order have no row."""
    if kind == "chrf":
        seqs = f"string_split({_drop_ws('t')}, '') AS c, {_chrf_words('t')} AS w"
        wide = f"{_wide('by_char', 'c', 'id, side', 6)}, {_wide('by_word', 'w', 'id, side', 2)}"
        grams = f"{_long('by_char', 'id, side', list('123456'))} UNION ALL {_long('by_word', 'id, side', list('78'))}"
    else:
        seqs = f"{_bleu_tokens('t')} AS c"
        wide = _wide("by_token", "c", "id, side", 4)
        grams = _long("by_token", "id, side", list("1234"))
    return f"""WITH pairs AS ({view}),
        seqs AS (SELECT id, side, {seqs} FROM (
            SELECT id, 'h' AS side, hyp AS t FROM pairs UNION ALL SELECT id, 'r', ref FROM pairs)),
        {wide}, grams AS ({grams}),
        each AS (SELECT id, ord, gram, count(*) FILTER (side = 'h') AS h, count(*) FILTER (side = 'r') AS r
                 FROM grams GROUP BY ALL),
        stats AS (SELECT id, ord, sum(h)::BIGINT AS h, sum(r)::BIGINT AS r, sum(least(h, r))::BIGINT AS m
                  FROM each GROUP BY ALL)"""


def _full_stats(view: str, kind: str, zero_hyp: bool) -> str:
    orders = 8 if kind == "chrf" else 4
    h = "CASE WHEN r > 0 THEN h ELSE 0 END" if zero_hyp else "h"
    return f"""{_gram_stats(view, kind)},
        full_stats AS (SELECT id, ord, {h} AS h, r, m FROM (
            SELECT p.id, o.ord, coalesce(h, 0) AS h, coalesce(r, 0) AS r, coalesce(m, 0) AS m
            FROM pairs p CROSS JOIN range(1, {orders + 1}) o(ord) LEFT JOIN stats s ON s.id = p.id AND s.ord = o.ord))"""


# chrF from rows (key, ord, h, r, m); a key without usable orders scores 0.
def _chrf_of(rows: str, key: str) -> str:
    return f"""SELECT {key}, coalesce(CASE WHEN 4 * p + r > 0 THEN 500 * p * r / (4 * p + r) END, 0) AS chrf FROM (
        SELECT {key}, avg(m / h) FILTER (h > 0 AND r > 0) AS p, avg(m / r) FILTER (h > 0 AND r > 0) AS r
        FROM ({rows}) GROUP BY {key})"""


def _bleu_of(rows: str, key: str) -> str:
    """BLEU from rows (key, ord 1..4, h, r, m): m correct, h total, lengths are the order-1 totals."""
    return f"""SELECT {key}, CASE WHEN sum(m) > 0 AND min(h) > 0 THEN
            (CASE WHEN max(h) FILTER (ord = 1) < max(r) FILTER (ord = 1)
                  THEN exp(1 - max(r) FILTER (ord = 1) / max(h) FILTER (ord = 1)) ELSE 1 END)
            * exp(avg(CASE WHEN h > 0 THEN ln(CASE WHEN m > 0 THEN 100.0 * m / h ELSE 100.0 / (pow(2, misses) * h) END) END))
        ELSE 0 END AS bleu
        FROM (SELECT *, count(*) FILTER (m = 0) OVER (PARTITION BY {key} ORDER BY ord) AS misses FROM ({rows}))
        GROUP BY {key}"""


def _by_lang(kind: str, name: str) -> str:
    score = _chrf_of if kind == "chrf" else _bleu_of
    rows = """SELECT lang, ord, sum(h) AS h, sum(r) AS r, sum(m) AS m
        FROM full_stats JOIN (SELECT doc_id AS id, lang FROM documents) USING (id) GROUP BY lang, ord"""
    return f"{_full_stats(NOISY, kind, kind == 'chrf')} SELECT lang, round({name}, 6) AS {name} FROM ({score(rows, 'lang')})"


TOKEN_STATS = """tok AS (SELECT id, side, unnest(toks) AS t FROM (
        SELECT id, 'h' AS side, {h} AS toks FROM pairs UNION ALL SELECT id, 'r', {r} FROM pairs)),
    per_tok AS (SELECT id, t, count(*) FILTER (side = 'h') AS h, count(*) FILTER (side = 'r') AS r FROM tok GROUP BY ALL),
    per_id AS (SELECT id, sum(h)::BIGINT AS h, sum(r)::BIGINT AS r, sum(least(h, r))::BIGINT AS c FROM per_tok GROUP BY id),
    prf AS (SELECT id, hyp_tokens, ref_tokens, common, precision, recall,
            CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1
        FROM (SELECT p.id, coalesce(h, 0) AS hyp_tokens, coalesce(r, 0) AS ref_tokens, coalesce(c, 0) AS common,
                     CASE WHEN h > 0 THEN c / h ELSE 0.0 END AS precision, CASE WHEN r > 0 THEN c / r ELSE 0.0 END AS recall
              FROM pairs p LEFT JOIN per_id USING (id)))""".format(h=_tokens("hyp"), r=_tokens("ref"))

LENGTHS = """sqrt(avg((hyp_tokens - ref_tokens) ** 2)) AS rmse,
    CASE WHEN stddev_pop(hyp_tokens) > 0 AND stddev_pop(ref_tokens) > 0
         THEN covar_pop(hyp_tokens, ref_tokens) / (stddev_pop(hyp_tokens) * stddev_pop(ref_tokens)) ELSE 0.0 END AS pearson,
    CASE WHEN var_pop(ref_tokens) > 0
         THEN 1 - sum((hyp_tokens - ref_tokens) ** 2) / (var_pop(ref_tokens) * count(*)) ELSE 0.0 END AS r2"""


def _report(view: str) -> str:
    """Each block of counts is a table of its own: (k, ord, h, r, m) summed over all pairs."""

    def summed(kind: str) -> str:
        stats = _full_stats(view, kind, kind == "chrf")
        return f"{stats} SELECT 1 AS k, ord, sum(h) AS h, sum(r) AS r, sum(m) AS m FROM full_stats GROUP BY ord"

    return f"""WITH pairs AS ({view}), {TOKEN_STATS},
        c AS ({_chrf_of(summed('chrf'), 'k')}), b AS ({_bleu_of(summed('bleu'), 'k')}),
        t AS (SELECT 100 * avg(precision) AS precision, 100 * avg(recall) AS recall, 100 * avg(f1) AS f1, {LENGTHS} FROM prf),
        e AS (SELECT 100 * avg((hyp = ref)::INT) AS accuracy FROM pairs)
        SELECT round(chrf, 6) AS chrf, round(bleu, 6) AS bleu, round(sqrt(chrf * bleu), 6) AS geo_mean,
               round(accuracy, 6) AS accuracy, round(precision, 6) AS precision, round(recall, 6) AS recall,
               round(f1, 6) AS f1, round(rmse, 6) AS rmse, round(pearson, 6) AS pearson, round(r2, 6) AS r2
        FROM c JOIN b USING (k) CROSS JOIN t CROSS JOIN e"""


POOL = "SELECT conv_id AS id, text, min(turn) AS pos FROM conversations GROUP BY ALL"


def _mbr() -> str:
    """CTEs ending in ``utilities``: n-grams of every distinct candidate once, joined inside each id."""
    seqs = {
        "c": (f"string_split({_drop_ws('text')}, '')", 6),
        "w": (_chrf_words("text"), 2),
        "b": (_bleu_tokens("text"), 4),
    }
    wide = ", ".join(_wide(f"by_{name}", name, "id, pos", orders) for name, (_, orders) in seqs.items())
    grams = " UNION ALL ".join(
        _long(f"by_{name}", "id, pos", [f"'{name}{n}'" for n in range(1, orders + 1)]) for name, (_, orders) in seqs.items()
    )
    names = ", ".join(f"('{name}{n}')" for name, (_, orders) in seqs.items() for n in range(1, orders + 1))
    score = f"""scored AS (
        SELECT c.id, c.hyp, c.ref, chrf, bleu FROM
        (SELECT id, hyp, ref, chrf FROM (SELECT split_part(k, ':', 1)::BIGINT AS id, split_part(k, ':', 2)::BIGINT AS hyp,
             split_part(k, ':', 3)::BIGINT AS ref, chrf FROM ({_chrf_of("SELECT id || ':' || hyp || ':' || ref AS k, ord, h, r, m FROM per_pair WHERE ord[1] <> 'b'", 'k')}))) c
        JOIN (SELECT split_part(k, ':', 1)::BIGINT AS id, split_part(k, ':', 2)::BIGINT AS hyp,
             split_part(k, ':', 3)::BIGINT AS ref, bleu FROM ({_bleu_of("SELECT id || ':' || hyp || ':' || ref AS k, ord[2]::INT AS ord, h, r, m FROM per_pair WHERE ord[1] = 'b'", 'k')})) b
        USING (id, hyp, ref))"""
    return f"""WITH pool AS ({POOL}),
        seqs AS (SELECT id, pos, {', '.join(f'{e} AS {n}' for n, (e, _) in seqs.items())} FROM pool),
        {wide}, grams AS (SELECT id, pos, ord, gram, count(*) AS n FROM ({grams}) GROUP BY ALL),
        totals AS (SELECT id, pos, ord, coalesce(sum(n), 0)::BIGINT AS n FROM pool CROSS JOIN (VALUES {names}) o(ord)
                   LEFT JOIN grams USING (id, pos, ord) GROUP BY ALL),
        shared AS (SELECT a.id, a.pos AS hyp, b.pos AS ref, a.ord, sum(least(a.n, b.n))::BIGINT AS m
                   FROM grams a JOIN grams b ON a.id = b.id AND a.ord = b.ord AND a.gram = b.gram AND a.pos <> b.pos GROUP BY ALL),
        per_pair AS (SELECT a.id, a.pos AS hyp, b.pos AS ref, a.ord, a.n AS h, b.n AS r, coalesce(m, 0) AS m
                     FROM totals a JOIN totals b ON a.id = b.id AND a.ord = b.ord AND a.pos <> b.pos
                     LEFT JOIN shared s ON s.id = a.id AND s.hyp = a.pos AND s.ref = b.pos AND s.ord = a.ord),
        {score},
        utilities AS (SELECT p.id, p.pos, p.text, count(s.ref) AS partners, coalesce(avg(chrf), 0) AS chrf,
                      coalesce(avg(bleu), 0) AS bleu, sqrt(coalesce(avg(chrf), 0) * coalesce(avg(bleu), 0)) AS utility
                      FROM pool p LEFT JOIN scored s ON s.id = p.id AND s.hyp = p.pos GROUP BY ALL)"""


LOGS = """SELECT event_id, event_type, user_id, CASE WHEN event_type = 'click' THEN '{''loss'': 1.5}'
    ELSE '{''loss'': 1.5, ''eval_geo_mean'': ' || value::VARCHAR || ', ''eval_BLEU'': 2.0}' END AS line FROM events"""
LOG_VALUES = f"""SELECT *, try_cast(nullif(regexp_extract(line, '''eval_geo_mean'':\\s*([\\d.]+)', 1), '') AS DOUBLE) AS value
    FROM ({LOGS})"""

PIECES = f"SELECT doc_id AS id, {_tokens('text')} AS pieces FROM documents"
VOCABULARY = f"""SELECT * FROM (VALUES ('<s>', 0, 0), ('<pad>', 0, 1), ('</s>', 0, 2), ('<unk>', 0, 3)) s(piece, n, piece_id)
    UNION ALL SELECT piece, n, row_number() OVER (ORDER BY n DESC, piece) + 3 FROM (
        SELECT piece, count(*) AS n FROM (SELECT unnest(pieces) AS piece FROM ({PIECES})) GROUP BY piece
        ORDER BY n DESC, piece LIMIT {VOCAB})"""
ENCODED = f"""WITH vocab AS ({VOCABULARY}), docs AS ({PIECES}),
    cut AS (SELECT id, unnest(pieces[1:127]) AS piece, generate_subscripts(pieces[1:127], 1) AS pos FROM docs),
    found AS (SELECT id, pos, piece, coalesce(piece_id, 3) AS piece_id FROM cut LEFT JOIN vocab USING (piece)),
    ids AS (SELECT docs.id, list(piece_id ORDER BY pos) FILTER (pos IS NOT NULL) AS ids,
                   list(piece ORDER BY pos) FILTER (piece_id > 3) AS known
            FROM docs LEFT JOIN found USING (id) GROUP BY docs.id)"""
CLOSED = "list_append(coalesce(ids, []), 2)"

VARIANTS = " UNION ALL ".join(
    ["SELECT doc_id, text, 'baseline' AS variant FROM documents"]
    + [f"SELECT doc_id, {_fold('text', m)}, '{name}' FROM documents" for name, m in LATIN_VARIANTS.items()]
)
CANDIDATES = "SELECT conv_id AS id, role AS model, turn AS model_step, turn AS pos, text FROM conversations"

ORACLES: dict[str, str] = {
    "clean_pairs": f"""SELECT * FROM (SELECT doc_id AS pair_id, {_re_strip("'  ' || text || chr(13) || chr(10)")} AS source,
        {_re_strip(f"CASE WHEN n_chars < 200 THEN ' ' || chr(9) ELSE ' ' || {_respelled('text')} END")} AS target
        FROM documents) WHERE source <> '' AND target <> ''""",
    "dedup_first": """SELECT doc_id, text, lang, source FROM (
        SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1""",
    "script_ratio": f"""SELECT lang, round(sum(length(regexp_replace(text, '[^A-Za-z]+', '', 'g'))) / v, 6) AS latin,
        round(sum(length(regexp_replace(text, '[^\\x{{C0}}-\\x{{24F}}]+', '', 'g'))) / v, 6) AS accented,
        round(sum(length(regexp_replace(text, '[^{ARABIC}]+', '', 'g'))) / v, 6) AS arabic
        FROM (SELECT *, sum(length({_drop_ws('text')})) OVER (PARTITION BY lang) AS v FROM documents) GROUP BY lang, v""",
    "script_guard": f"""SELECT round(s, 6) AS source_ratio, round(t, 6) AS target_ratio, s >= 0.5 AND t >= 0.2 AS ok FROM (
        SELECT sum(length(regexp_replace(text, '[^A-Za-z]+', '', 'g'))) / sum(length({_drop_ws('text')})) AS s,
               sum(length(regexp_replace(target, '[^{ARABIC}]+', '', 'g'))) / sum(length({_drop_ws('target')})) AS t
        FROM (SELECT text, translate(text, 'aeiou', 'اےیوہ') AS target FROM documents))""",
    "target_guard": f"""SELECT round(s, 6) AS source_ratio, round(t, 6) AS target_ratio, t >= 0.2 AS ok FROM (
        SELECT sum(length(regexp_replace(target, '[^A-Za-z]+', '', 'g'))) / sum(length({_drop_ws('target')})) AS s,
               sum(length(regexp_replace(target, '[^\u0600-\u06FF\u0750-\u077F]+', '', 'g'))) / sum(length({_drop_ws('target')})) AS t
        FROM (SELECT translate(text, 'aeiou', 'اےیوہ') AS target FROM documents))""",
    "exact_match_missing": f"SELECT round(avg(CASE WHEN length(hyp) >= 80 THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM ({PAIRS})",
    "hash_split": _hash_split("text", "doc_id"),
    "split_sizes": f"SELECT split, count(*) AS n FROM ({_hash_split('text', 'doc_id')}) GROUP BY split",
    "split_overlap": f"""SELECT count(*) FILTER (tr AND va) AS train_val, count(*) FILTER (tr AND te) AS train_test,
        count(*) FILTER (va AND te) AS val_test FROM (
        SELECT text, bool_or(split = 'train') AS tr, bool_or(split = 'val') AS va, bool_or(split = 'test') AS te
        FROM ({_hash_split('doc_id', 'text')}) GROUP BY text)""",
    "exact_split": """SELECT doc_id, CASE WHEN rn <= t THEN 'test'
            WHEN rn <= t + ceil((0.1::DOUBLE / (1 - 0.1::DOUBLE)) * (n - t)) THEN 'val' ELSE 'train' END AS split
        FROM (SELECT doc_id, n, rn, ceil(0.1::DOUBLE * n) AS t FROM (SELECT doc_id, count(*) OVER () AS n,
              row_number() OVER (ORDER BY md5(doc_id || '#42'), doc_id) AS rn FROM documents))""",
    "seeded_sample": "SELECT doc_id, lang, text FROM documents ORDER BY md5(doc_id || '#42'), doc_id LIMIT 500",
    "head_eval": f"SELECT * FROM ({NOISY}) ORDER BY id LIMIT 500",
    "nfc_text": f"SELECT doc_id, nfc_normalize({_decomposed('text')}) AS text FROM documents",
    "char_counts": f"SELECT ch, n, round(pct, 6) AS pct FROM ({COUNTS})",
    "top_chars": f"""SELECT ch, n, round(pct, 6) AS pct, printf('U+%04X', unicode(ch)) AS label FROM ({COUNTS})
        ORDER BY n DESC, ch LIMIT 50""",
    "variant_usage": f"""SELECT group_id, ch, n, round(100.0 * n / total, 6) AS pct_of_group, rank FROM (
        SELECT group_id, ch, n, sum(n) OVER (PARTITION BY group_id) AS total, count(*) OVER (PARTITION BY group_id) AS variants,
               row_number() OVER (PARTITION BY group_id ORDER BY n DESC, ord) AS rank
        FROM ({COUNTS}) JOIN ({GROUPS}) v(group_id, ch, ord) USING (ch)) WHERE variants >= 2""",
    "learn_char_map": _learned(COUNTS, 0.9),
    "char_map_merge": f"""SELECT from_ch, coalesce(n.to_ch, o.to_ch) AS to_ch
        FROM ({_learned(f"SELECT ch, count(*) AS n FROM ({CHARS}) WHERE lang = 'de' GROUP BY ch", 0.5)}) o
        FULL JOIN ({_learned(COUNTS, 0.9)}) n USING (from_ch)""",
    "char_map_apply": f"SELECT doc_id, {_fold(f'nfc_normalize({_decomposed('text')})', FOLD)} AS text FROM documents",
    "variant_fanout": VARIANTS,
    "prefix_source": "SELECT doc_id, 'eng_Latn kas_Arab ' || text AS text FROM documents",
    "suffix_attach": f"SELECT doc_id, regexp_replace(text, '[{WS}]+tion', 'tion', 'g') AS text FROM documents",
    # mark the occurrences that have whitespace before them, space out the others, unmark
    "suffix_detach": f"""SELECT doc_id, replace(replace(regexp_replace(text, '([{WS}])ment', '\\1' || chr(1), 'g'),
        'ment', ' ment'), chr(1), 'ment') AS text FROM documents""",
    "tokenize": f"""SELECT doc_id, array_to_string(t, ' ') AS tokens, len(t) AS n
        FROM (SELECT doc_id, {_tokens('text')} AS t FROM documents)""",
    "token_prf": f"""WITH pairs AS ({NOISY}), {TOKEN_STATS} SELECT prf.id, lang, hyp_tokens, ref_tokens, common,
        round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM prf JOIN pairs USING (id)""",
    "token_prf_macro": f"""WITH pairs AS ({PAIRS}), {TOKEN_STATS} SELECT round(avg(precision), 6) AS precision,
        round(avg(recall), 6) AS recall, round(avg(f1), 6) AS f1 FROM prf""",
    "length_stats": f"""SELECT lang, round(rmse, 6) AS rmse, round(pearson, 6) AS pearson, round(r2, 6) AS r2 FROM (
        SELECT lang, {LENGTHS} FROM (SELECT lang, len({_tokens('hyp')}) AS hyp_tokens, len({_tokens('ref')}) AS ref_tokens
        FROM ({NOISY})) GROUP BY lang)""",
    "exact_match": f"SELECT lang, round(avg((hyp = ref)::INT), 6) AS accuracy FROM ({NOISY}) GROUP BY lang",
    "align_check": """SELECT sum(h)::BIGINT AS n_hyp, sum(r)::BIGINT AS n_ref, count(*) FILTER (h > 0 AND r > 0) AS matched,
        count(*) FILTER (h > 0 AND r = 0) AS only_hyp, count(*) FILTER (h = 0 AND r > 0) AS only_ref,
        count(*) FILTER (h > 1 OR r > 1) AS repeated
        FROM (SELECT doc_id, sum(h) AS h, sum(r) AS r FROM (SELECT doc_id, 1 AS h, 0 AS r FROM labels
        UNION ALL SELECT doc_id, 0, 1 FROM documents) GROUP BY doc_id)""",
    "scored_pairs": """SELECT a.conv_id || ':' || a.turn AS id, a.role, a.text, b.text AS predicted_text
        FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1""",
    "submission": f'SELECT doc_id AS "ID", {_respelled("text")} AS kashmiri_text FROM documents',
    "chrf_stats": f"{_full_stats(NOISY, 'chrf', True)} SELECT * FROM full_stats",
    "chrf_grams": f"{_gram_stats(PAIRS, 'chrf')} SELECT id, ord::BIGINT AS ord, h, r, m FROM stats",
    "chrf_corpus": _by_lang("chrf", "chrf"),
    "bleu_stats": f"{_full_stats(NOISY, 'bleu', False)} SELECT * FROM full_stats",
    "bleu_corpus": _by_lang("bleu", "bleu"),
    "corpus_report": _report(NOISY),
    "corpus_report_pairs": _report(PAIRS),
    "sentence_scores": f"""SELECT id, round(chrf, 6) AS chrf, round(bleu, 6) AS bleu
        FROM ({_chrf_of(f"{_full_stats(PAIRS, 'chrf', True)} SELECT * FROM full_stats", 'id')})
        JOIN ({_bleu_of(f"{_full_stats(PAIRS, 'bleu', False)} SELECT * FROM full_stats", 'id')}) USING (id)""",
    "regroup_flat": "SELECT conv_id * 8 + turn AS pos, text, (conv_id * 8 + turn) // 4 AS id, (conv_id * 8 + turn) % 4 AS rank FROM conversations",
    "candidate_pool": """SELECT conv_id AS id, role AS model, turn AS rank, text, turn + 4294967296 *
        CASE role WHEN 'assistant' THEN 0 WHEN 'user' THEN 1 ELSE 2 END AS pos FROM conversations""",
    "candidate_dedup": POOL,
    "latest_models": f"""SELECT * FROM ({CANDIDATES}) WHERE model IN (
        SELECT role FROM conversations GROUP BY role ORDER BY max(turn) DESC, role LIMIT 2)""",
    "mbr_utilities": f"""{_mbr()} SELECT id, pos, partners, round(chrf, 6) AS chrf, round(bleu, 6) AS bleu,
        round(utility, 6) AS utility FROM utilities""",
    "mbr_select": f"""{_mbr()} SELECT id, pos, text, round(utility, 6) AS utility FROM (SELECT *, row_number() OVER (
        PARTITION BY id ORDER BY round(utility, 9) DESC, pos) AS rn FROM utilities) WHERE rn = 1""",
    "mbr_choose": f"""{_mbr()} SELECT id, pos, text, round(utility, 6) AS utility, pairs FROM (SELECT *,
        (sum(partners) OVER (PARTITION BY id))::BIGINT AS pairs,
        row_number() OVER (PARTITION BY id ORDER BY round(utility, 9) DESC, pos) AS rn FROM utilities) WHERE rn = 1""",
    "mbr_weighted": f"""{_mbr()}, weights AS (SELECT conv_id AS id, text, sum(length(text) % 5 + 0.5)::DOUBLE AS w
            FROM conversations GROUP BY ALL),
        means AS (SELECT p.id, p.pos, count(s.ref) AS partners, coalesce(sum(w * chrf) / sum(w), 0) AS chrf,
                  coalesce(sum(w * bleu) / sum(w), 0) AS bleu FROM pool p LEFT JOIN scored s ON s.id = p.id AND s.hyp = p.pos
                  LEFT JOIN pool q ON q.id = s.id AND q.pos = s.ref
                  LEFT JOIN weights v ON v.id = q.id AND v.text = q.text GROUP BY ALL)
        SELECT id, pos, partners, round(chrf, 6) AS chrf, round(bleu, 6) AS bleu, round(sqrt(chrf * bleu), 6) AS utility
        FROM means""",
    "build_vocab": VOCABULARY,
    "encode_labels": f"{ENCODED} SELECT id, array_to_string({CLOSED}, ' ') AS labels FROM ids",
    "encode_inputs": f"""{ENCODED} SELECT id, array_to_string({CLOSED}, ' ') AS input_ids,
        array_to_string(list_transform({CLOSED}, lambda x: 1), ' ') AS attention_mask FROM ids""",
    "decode_labels": f"{ENCODED} SELECT id, coalesce(array_to_string(known, ' '), '') AS text FROM ids",
    "param_grid": """SELECT event_type, lora_r, learning_rate, 2 * r_at + l_at AS trial FROM (SELECT DISTINCT event_type FROM events)
        CROSS JOIN (VALUES (4, 0), (8, 1), (16, 2)) r(lora_r, r_at) CROSS JOIN (VALUES (3e-5, 0), (5e-5, 1)) l(learning_rate, l_at)""",
    "log_metric": f"SELECT event_id, value AS eval_geo_mean FROM ({LOG_VALUES})",
    "leaderboard": f"SELECT event_type || '-' || user_id AS trial, max(value) AS geo_mean FROM ({LOG_VALUES}) GROUP BY ALL",
    "best_step": f"""SELECT user_id, event_id, value AS geo_mean FROM (SELECT *, row_number() OVER (PARTITION BY user_id
        ORDER BY value DESC, event_id) AS rn FROM ({LOG_VALUES}) WHERE value IS NOT NULL) WHERE rn = 1""",
}
