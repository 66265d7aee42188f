"""DuckDB SQL for every query of ``queries`` that SQL can express, over the same whole tables."""

from __future__ import annotations

from plumbline.operators import rules as r
from plumbline.functions import text as t
from plumbline.plans import queries as q


def _in(words) -> str:
    return "(" + ", ".join("'" + w + "'" for w in words) + ")"


_TOKS = "regexp_extract_all(lower(text), '[a-z0-9'']+')"


def _cases(pick: str, options) -> str:
    return f"CASE {pick} " + " ".join(f"WHEN {i} THEN {o}" for i, o in enumerate(options)) + " END"


_ANSWER = {
    "brand": "lower(p_brand)",
    "kind": "lower(p_type)",
    "size": "(p_size % 15)::VARCHAR",
    "yesno": "CASE p_size % 5 WHEN 0 THEN ' Yes' WHEN 1 THEN 'no' WHEN 2 THEN 'maybe' WHEN 3 THEN 'NO ' ELSE 'on the left' END",
}
_QUESTIONS = f"""
questions AS (
  SELECT p_partkey AS question_id, p_partkey % 1000 AS image_id,
    replace(replace({_cases(f"p_partkey % {len(q.QUESTIONS)}", ["'" + x + "'" for x, _ in q.QUESTIONS])}, '{{n}}', p_name), '{{k}}', lower(p_type)) AS question,
    {_cases(f"p_partkey % {len(q.QUESTIONS)}", [_ANSWER[a] for _, a in q.QUESTIONS])} AS answer
  FROM part
)"""

_NUM = "CASE a0 " + " ".join(f"WHEN '{i}' THEN '{w}'" for i, w in enumerate(t.NUMBER_WORDS)) + " ELSE a0 END"


def _article(x: str) -> str:
    return f"CASE WHEN {x} = '' OR regexp_extract({x}, '^\\S+') IN {_in(t.DETERMINERS)} THEN {x} WHEN regexp_matches({x}, '^[aeiou]') THEN 'an ' || {x} ELSE 'a ' || {x} END"


def _cap(x: str) -> str:
    return f"upper(left({x}, 1)) || substr({x}, 2)"


_NEG = r"^(The|There|This|That|These|Those)\s+(.+?)\s+(is|are|was|were|has|have|can)\s+(.+)$"


def _negated(x: str) -> str:
    s = f"regexp_replace({x}, '\\.+$', '')"
    return f"CASE WHEN regexp_matches({s}, '{_NEG}', 'i') THEN regexp_replace({s}, '{_NEG}', '\\1 \\2 \\3 not \\4.', 'i') ELSE 'It is not true that ' || lower({s}) || '.' END"


_COLOR = r"^what color(?:s)? (?:is|are) (?:the )?(.+)$"
_MANY = r"^how many (.+?)(?: are there| is there| are in| is in| in .+| on .+)?$"
_DOING = r"^what is (?:the )?(.+?) doing$"
_KIND = r"^what (?:kind|type) of (.+?)(?: is this| are these| is that| are those| is in .+)?$"
_WHERE = r"^where (?:is|are) (?:the )?(.+)$"
_BE = "CASE WHEN contains(q, ' are ') THEN 'are' ELSE 'is' END"


def _g(pattern: str, k: int = 1, of: str = "q") -> str:
    return f"trim(regexp_extract({of}, '{pattern}', {k}))"


def _m(pattern: str, of: str = "q") -> str:
    return f"regexp_matches({of}, '{pattern}')"


_YESNO = r"^(is|are|was|were|does|do|did|can|could) (.+)$"
_THIS = r"^(this|that|these|those)\s+(.+)$"
_BRAND = r"^what (brand|sport|room|animal|vehicle|food|drink) (.+)$"
_IS = r"^what is (?:the )?(.+?)(?: on .+| in .+| near .+)?$"

CAPTIONS = f"""{_QUESTIONS},
plain AS (
  SELECT *, lower(regexp_replace(regexp_replace(question, '^\\s+|\\s+$', '', 'g'), '\\?+$', '')) AS q,
    lower(regexp_replace(answer, '^\\s+|\\s+$', '', 'g')) AS a0 FROM questions
),
answered AS (SELECT *, {_NUM} AS a FROM plain),
parts AS (
  SELECT *, a IN {_in(t.YES)} AS yes, a IN {_in(t.NO)} AS no, regexp_extract(q, '{_YESNO}', 1) AS aux, {_g(_YESNO, 2)} AS rest FROM answered
),
clause AS (
  SELECT *, regexp_split_to_array(rest, '\\s+') AS w FROM parts
),
split AS (
  SELECT *, CASE WHEN len(w) < 2 THEN rest WHEN w[1] = 'the' AND len(w) >= 3 THEN w[1] || ' ' || w[2] ELSE w[1] END AS subj,
    CASE WHEN len(w) < 2 THEN '' WHEN w[1] = 'the' AND len(w) >= 3 THEN array_to_string(w[3:], ' ') ELSE array_to_string(w[2:], ' ') END AS pred
  FROM clause
),
fact AS (
  SELECT *, CASE WHEN aux IN ('is', 'was') AND {_m(_THIS, 'rest')} THEN {_cap(_g(_THIS, 1, 'rest'))} || ' is ' || {_g(_THIS, 2, 'rest')} || '.'
    WHEN aux IN ('is', 'are', 'was', 'were') THEN 'The ' || regexp_replace(subj, '^the ', '') || CASE WHEN aux IN ('are', 'were') THEN ' are ' ELSE ' is ' END || pred || '.'
    WHEN aux IN ('does', 'do', 'did') THEN 'The ' || regexp_replace(subj, '^the ', '') || ' ' || pred || '.' END AS said
  FROM split
),
tried AS (
  SELECT *,
    CASE WHEN {_m(_COLOR)} THEN 'The ' || {_g(_COLOR)} || ' ' || {_BE} || ' ' || a || '.' END AS what_color,
    CASE WHEN {_m(_MANY)} THEN CASE WHEN no OR a IN ('zero', 'none') THEN 'There are no ' || {_g(_MANY)} || '.' WHEN a IN ('one', '1') THEN 'There is one ' || {_g(_MANY)} || '.'
      ELSE 'There are ' || a || ' ' || {_g(_MANY)} || '.' END END AS how_many,
    CASE WHEN {_m(_DOING)} THEN 'The ' || {_g(_DOING)} || ' is ' || a || '.' END AS what_is_doing,
    CASE WHEN {_m(_KIND)} THEN CASE WHEN regexp_matches(q, 'this|that') THEN 'This is ' || {_article('a')} || '.' WHEN regexp_matches(q, 'these|those') THEN 'These are ' || {_article('a')} || '.'
      ELSE 'The ' || {_g(_KIND)} || ' is ' || {_article('a')} || '.' END END AS what_kind_type,
    CASE WHEN {_m(_WHERE)} THEN 'The ' || {_g(_WHERE)} || ' ' || {_BE} || ' ' || a || '.' END AS "where",
    CASE WHEN {_m('^who (?:is|are) (.+)$')} THEN {_cap('a')} || ' ' || {_BE} || ' ' || {_g('^who (?:is|are) (.+)$')} || '.' END AS who,
    CASE WHEN {_m('^which (.+)$')} THEN 'The ' || {_g('^which (.+)$')} || ' is ' || a || '.' END AS which,
    CASE WHEN {_m('^is there (?:a|an) (.+)$')} THEN CASE WHEN yes THEN 'There is ' || {_article(_g('^is there (?:a|an) (.+)$'))} || '.' WHEN no THEN 'There is no ' || {_g('^is there (?:a|an) (.+)$')} || '.'
      ELSE 'There is ' || {_article('a')} || ' ' || {_g('^is there (?:a|an) (.+)$')} || '.' END END AS is_there,
    CASE WHEN {_m('^are there (?:any )?(.+)$')} THEN CASE WHEN yes THEN 'There are ' || {_g('^are there (?:any )?(.+)$')} || '.' WHEN no THEN 'There are no ' || {_g('^are there (?:any )?(.+)$')} || '.'
      ELSE 'There are ' || a || ' ' || {_g('^are there (?:any )?(.+)$')} || '.' END END AS are_there,
    CASE WHEN {_m(_YESNO)} THEN CASE WHEN yes THEN said WHEN no THEN {_negated('said')} END END AS is_are_yesno,
    CASE WHEN {_m(_BRAND)} THEN 'The ' || {_g(_BRAND)} || ' ' || {_g(_BRAND, 2)} || ' is ' || a || '.' END AS what_brand_sport,
    CASE WHEN {_m(_IS)} AND NOT yes AND NOT no THEN 'The ' || {_g(_IS)} || ' is ' || a || '.' END AS what_is,
    {_cap("regexp_replace(trim(q), '\\?+$', '')")} || CASE WHEN yes THEN ' — yes.' WHEN no THEN ' — no.' ELSE ' The answer is ' || a || '.' END AS fallback
  FROM fact
),
captions AS (
  SELECT question_id, image_id, question, answer, coalesce({", ".join(f'"{n}"' for n, _ in r.RULES)}, fallback) AS caption,
    CASE {" ".join(f'WHEN "{n}" IS NOT NULL THEN ' + "'" + n + "'" for n, _ in r.RULES)} ELSE 'fallback' END AS rule
  FROM tried
)"""

_HIST = "hist AS (SELECT rule, count(*) AS n, 100.0 * count(*) / (SELECT count(*) FROM captions) AS percent FROM captions GROUP BY rule)"
_SOFT = "acc AS (SELECT user_id, least(sum((lower(trim(event_type)) = 'click')::INT) / 3.0::DOUBLE, 1.0::DOUBLE) AS acc FROM events GROUP BY user_id)"
_VOCAB = f"""vocab AS (
  SELECT word, row_number() OVER (ORDER BY word) + 3 AS id, n
  FROM (SELECT word, count(*) AS n FROM (SELECT unnest({_TOKS}) AS word FROM documents) GROUP BY word HAVING count(*) >= {q.MIN_FREQ})
)"""


def _enc(slice_: str = "") -> str:
    return f"""{_VOCAB},
toks AS (SELECT doc_id, {_TOKS}{slice_} AS ws FROM documents),
long AS (SELECT doc_id, unnest(generate_series(1, len(ws))) AS pos, unnest(ws) AS word FROM toks),
got AS (SELECT doc_id, list(coalesce(id, 3) ORDER BY pos) AS own FROM long LEFT JOIN vocab USING (word) GROUP BY doc_id),
enc AS (SELECT doc_id, list_concat([1::BIGINT], coalesce(own, []), [2::BIGINT]) AS ids FROM toks LEFT JOIN got USING (doc_id))"""


_MD5 = "len(ids)::BIGINT AS n_ids, md5(array_to_string(ids, ' ')) AS ids_md5"
_GRP = "coalesce(lang, '') || '/' || coalesce(source, '')"
_LISTS = f"lists AS (SELECT {_GRP} AS grp, list(doc_id ORDER BY doc_id) AS ids FROM documents GROUP BY 1)"
_TEXTS = f"texts AS (SELECT {_GRP} AS grp, doc_id, {_TOKS} AS toks FROM documents)"
_PAIRS = f"""{_TEXTS},
firsts AS (SELECT grp, min(doc_id) AS first FROM texts GROUP BY grp),
refs AS (SELECT grp, doc_id AS ref, toks FROM texts JOIN firsts USING (grp) WHERE doc_id <> first),
hyps AS (SELECT grp, toks FROM texts JOIN firsts USING (grp) WHERE doc_id = first AND grp IN (SELECT grp FROM refs))"""


def _grams(name: str, source: str, keys: str) -> str:
    return f"""{name} AS (
  SELECT {keys}, n, gram, count(*) AS c FROM (
    SELECT {keys}, n, array_to_string(list_slice(toks, i, i + n - 1), ' ') AS gram
    FROM (SELECT {keys}, toks, n, unnest(generate_series(1, len(toks) - n + 1)) AS i FROM {source}, (VALUES (1), (2), (3), (4)) v(n) WHERE len(toks) >= n)
  ) GROUP BY {keys}, n, gram
)"""


_BLEU = f"""{_PAIRS}, {_grams('hg', 'hyps', 'grp')}, {_grams('rg', 'refs', 'grp, ref')},
most AS (SELECT grp, n, gram, max(c) AS most FROM rg GROUP BY grp, n, gram),
clip AS (SELECT n, sum(least(c, coalesce(most, 0))) AS clipped FROM hg LEFT JOIN most USING (grp, n, gram) GROUP BY n),
tot AS (SELECT n, sum(greatest(len(toks) - n + 1, 0)) AS total FROM hyps, (VALUES (1), (2), (3), (4)) v(n) GROUP BY n),
near AS (
  SELECT h.grp, len(h.toks) AS hl, arg_min(len(r.toks), abs(len(r.toks) - len(h.toks)) * 1000000000 + len(r.toks)) AS rl
  FROM hyps h JOIN refs r ON r.grp = h.grp GROUP BY h.grp, len(h.toks)
),
lens AS (SELECT sum(hl) AS hl, sum(rl) AS rl FROM near),
prec AS (
  SELECT n, coalesce(clipped, 0) AS clipped, total, CASE WHEN total > 0 THEN coalesce(clipped, 0)::DOUBLE / total ELSE 0 END AS p,
    CASE WHEN hl = 0 THEN 0 WHEN hl > rl THEN 1 ELSE exp(1 - rl::DOUBLE / greatest(hl, 1)) END AS bp
  FROM tot LEFT JOIN clip USING (n), lens
),
bleu AS (
  SELECT a.n, a.clipped, a.total, CASE WHEN a.p > 0 THEN a.bp * exp(sum(CASE WHEN b.p > 0 THEN ln(b.p) ELSE -1e9 END) / a.n) ELSE 0 END AS bleu
  FROM prec a JOIN prec b ON b.n <= a.n GROUP BY a.n, a.clipped, a.total, a.p, a.bp
)"""
_CIDER = f"""df AS (SELECT n, gram, count(DISTINCT grp) AS df FROM rg GROUP BY n, gram),
ng AS (SELECT count(DISTINCT grp)::DOUBLE AS g FROM refs),
hw AS (SELECT grp, n, gram, c * (ln(g) - ln(greatest(coalesce(df, 0), 1)::DOUBLE)) AS w FROM hg LEFT JOIN df USING (n, gram), ng),
rw AS (SELECT grp, ref, n, gram, c * (ln(g) - ln(greatest(coalesce(df, 0), 1)::DOUBLE)) AS w FROM rg LEFT JOIN df USING (n, gram), ng),
hn AS (SELECT grp, n, sqrt(sum(w * w)) AS nh FROM hw GROUP BY grp, n),
rn AS (SELECT grp, ref, n, sqrt(sum(w * w)) AS nr FROM rw GROUP BY grp, ref, n),
dots AS (SELECT rw.grp, ref, n, sum(least(hw.w, rw.w) * rw.w) AS dot FROM rw JOIN hw USING (grp, n, gram) GROUP BY rw.grp, ref, n),
cos AS (SELECT grp, ref, sum(CASE WHEN nh * nr <> 0 THEN dot / (nh * nr) ELSE dot END) AS s FROM dots JOIN rn USING (grp, ref, n) JOIN hn USING (grp, n) GROUP BY grp, ref),
sim AS (
  SELECT r.grp, coalesce(s, 0) * exp(-((len(h.toks) - len(r.toks))::DOUBLE ** 2) / 72::DOUBLE) / 4 AS s
  FROM refs r JOIN hyps h USING (grp) LEFT JOIN cos ON cos.grp = r.grp AND cos.ref = r.ref
),
cider AS (SELECT grp, 10 * avg(s) AS cider FROM sim GROUP BY grp)"""
_EPOCHS = """(SELECT epoch, max(epoch) OVER () AS last, (sum(n) OVER (ORDER BY epoch))::BIGINT AS seen FROM (SELECT ((year(o_orderdate) - 1992) * 12 + month(o_orderdate))::BIGINT AS epoch, count(*) AS n FROM orders GROUP BY 1))"""
_TURNS = """pairs AS (
  SELECT a.conv_id, b.turn, a.text AS question, b.text AS answer FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1
  WHERE a.role = 'user' AND b.role = 'assistant'
)"""
_VEC = "vec AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings)"
_TOP = f"top AS (SELECT *, (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1)::INT AS slot FROM vec QUALIFY slot < {q.REGIONS})"
_LONG = "long AS (SELECT *, unnest(generate_series(0, len(x) - 1))::INT AS dim, unnest(x) AS v FROM {})"
_QUERIED = "quer AS (SELECT vec.*, f.query FROM vec JOIN (SELECT label, arg_min(x, vec_id) AS query FROM vec GROUP BY label) f USING (label))"
_ATTEND = """sc AS (SELECT label, x, {} AS s FROM quer),
e AS (SELECT label, x, exp(s - max(s) OVER (PARTITION BY label)) AS e FROM sc),
el AS (SELECT label, e, unnest(generate_series(0, len(x) - 1))::INT AS dim, unnest(x) AS v FROM e)
SELECT label, dim, round(sum(e * v) / sum(e), 6) AS value FROM el GROUP BY label, dim"""
_DOT = "list_sum(list_transform(list_zip(x, query), lambda p: p[1] * p[2]))"
_TANH = "list_sum(list_transform(list_zip(x, query), lambda p: tanh(p[1] + p[2])))"
_LSE = "(list_max(x) + ln(list_sum(list_transform(x, lambda y: exp(y - list_max(x))))))"


def _fused(expr: str) -> str:
    return f"""WITH {_VEC}, {_QUERIED}, f AS (SELECT label, vec_id, {expr} AS x FROM quer), {_LONG.format('f')}
SELECT label, vec_id, dim, round(v, 6) + 0 AS value FROM long"""


_DRAWN = "('0x' || left(md5('{}:' || {}), 15))::BIGINT"


ORACLES = {
    "mode_answer": """WITH c AS (SELECT user_id, lower(trim(event_type)) AS answer, count(*) AS votes, min(event_id) AS first FROM events GROUP BY 1, 2)
SELECT user_id, answer, votes FROM c QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY votes DESC, first) = 1""",
    "soft_accuracy": f"WITH {_SOFT} SELECT count(*) AS n, round(avg(acc), 6) AS accuracy FROM acc",
    "soft_accuracy_batched": f"""WITH {_SOFT}, b AS (SELECT user_id // 16 AS batch, avg(acc) AS m FROM acc GROUP BY 1)
SELECT round((SELECT avg(m) FROM b), 6) AS batch_mean, round((SELECT avg(acc) FROM acc), 6) AS mean""",
    "rule_captions": f"WITH {CAPTIONS} SELECT * FROM captions",
    "rule_histogram": f"WITH {CAPTIONS}, {_HIST} SELECT rule, n, percent::DOUBLE AS percent FROM hist",
    "rule_report": f"""WITH {CAPTIONS}, {_HIST}, {_LISTS}
SELECT 'samples' AS part, count(*)::VARCHAR AS line, 100.0::DOUBLE AS share FROM captions
UNION ALL SELECT 'rule', rule || ': ' || n::VARCHAR, round(percent::DOUBLE, 6) FROM hist
UNION ALL SELECT 'row', concat_ws(' | ', question, answer, caption, rule), NULL FROM (SELECT * FROM captions ORDER BY question_id LIMIT 5)
UNION ALL SELECT 'group', grp || ' | ' || ids[1]::VARCHAR || ' | ' || coalesce(ids[5]::VARCHAR, '-'), NULL FROM lists""",
    "tokenize": f"SELECT doc_id, len(ws)::BIGINT AS n_tokens, md5(array_to_string(ws, ' ')) AS tokens_md5 FROM (SELECT doc_id, {_TOKS} AS ws FROM documents)",
    "vocab_minfreq": f"WITH {_VOCAB} SELECT word, id, n FROM vocab",
    "encode_bos_eos": f"WITH {_enc()} SELECT doc_id, {_MD5} FROM enc",
    "encode_truncated": f"WITH {_enc(f'[1:{q.MOST_TOKENS - 2}]')} SELECT doc_id, array_to_string(ids, ' ') AS ids FROM enc",
    "pad_batch": f"""WITH {_enc()}, w AS (SELECT doc_id, ids, max(len(ids)) OVER (PARTITION BY doc_id // {q.BATCH}) AS w FROM enc),
p AS (SELECT doc_id, list_concat(ids, list_transform(generate_series(1, w - len(ids)), lambda x: 0::BIGINT)) AS ids FROM w)
SELECT doc_id, {_MD5} FROM p""",
    "decode_ids": f"""WITH {_VOCAB}, long AS (
  SELECT doc_id, unnest(generate_series(1, len(ws))) AS pos, unnest(ws) AS word FROM (SELECT doc_id, {_TOKS} AS ws FROM documents)
), d AS (SELECT doc_id, string_agg(CASE WHEN id IS NULL THEN '<unk>' ELSE word END, ' ' ORDER BY pos) AS text FROM long LEFT JOIN vocab USING (word) GROUP BY doc_id)
SELECT documents.doc_id, md5(coalesce(d.text, '')) AS text_md5 FROM documents LEFT JOIN d USING (doc_id)""",
    "vocab_roundtrip": f"WITH {_VOCAB} SELECT id, word FROM vocab UNION ALL SELECT * FROM (VALUES (0, '<pad>'), (1, '<bos>'), (2, '<eos>'), (3, '<unk>')) v(id, word)",
    "turn_pairs": f"WITH {_TURNS} SELECT * FROM pairs",
    "scan_counts": "SELECT role, count(*) AS n, count(DISTINCT conv_id) AS n_keys, sum(length(text))::BIGINT AS chars FROM conversations GROUP BY role",
    "key_intersection": "SELECT o_orderkey FROM orders INTERSECT SELECT l_orderkey FROM lineitem",
    "left_default": """WITH l AS (SELECT l_orderkey, list(l_linenumber ORDER BY l_linenumber) AS lines FROM lineitem GROUP BY 1)
SELECT o_orderkey AS l_orderkey, coalesce(len(lines), 0)::INT AS n_lines, coalesce(array_to_string(lines, ','), '') AS lines FROM orders LEFT JOIN l ON l_orderkey = o_orderkey""",
    "dedupe_last": """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_quantity DESC,
  l_extendedprice DESC, l_discount DESC, l_tax DESC, l_returnflag DESC, l_linestatus DESC) = 1""",
    "set_union": f"""SELECT o_orderkey::VARCHAR AS word FROM orders UNION SELECT l_orderkey::VARCHAR FROM lineitem
UNION SELECT * FROM (VALUES {", ".join(f"('{w}')" for w in (*t.YES, *t.NO))}) v(word)""",
    "cap_sorted": "SELECT o_orderkey AS l_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem) ORDER BY 1 LIMIT 1000",
    "cap_before_join": """SELECT o_orderkey AS l_orderkey, o_totalprice FROM (SELECT * FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 1000)
WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)""",
    "first_n_distinct": "SELECT user_id, min(event_id) AS first_at FROM events GROUP BY user_id ORDER BY first_at, user_id LIMIT 100",
    "split_lookup": """SELECT d.doc_id, coalesce(l.quality::BIGINT, d.n_chars) AS n_chars, CASE WHEN l.doc_id IS NULL THEN 'train' ELSE 'val' END AS split
FROM documents d LEFT JOIN labels l USING (doc_id)""",
    "captions_by_image": f"""WITH {_LISTS}, p AS (SELECT grp, ids, unnest(generate_series(0, (len(ids) - 1) // {q.LIST_PART})) AS k FROM lists)
SELECT grp, any_value(len(ids))::BIGINT AS n, md5(string_agg(md5(array_to_string(ids[k * {q.LIST_PART} + 1 : (k + 1) * {q.LIST_PART}], ',')), ',' ORDER BY k)) AS ids_md5 FROM p GROUP BY grp""",
    "flatten_captions": f"WITH {_LISTS} SELECT grp, unnest(generate_series(0, len(ids) - 1))::INT AS pos, unnest(ids) AS doc_id FROM lists",
    "path_template": "SELECT doc_id, 'COCO_val2014_' || lpad(doc_id::VARCHAR, 12, '0') || '.jpg' AS file FROM documents",
    "ngram_counts": f"WITH {_TEXTS}, {_grams('g', 'texts', 'grp')} SELECT grp, n, count(*) AS grams, sum(c)::BIGINT AS total, max(c) AS most FROM g GROUP BY grp, n",
    "doc_frequency": f"""WITH {_PAIRS}, {_grams('rg', 'refs', 'grp, ref')}, df AS (SELECT n, gram, count(DISTINCT grp) AS df FROM rg GROUP BY n, gram)
SELECT n, df, count(*) AS grams FROM df GROUP BY n, df""",
    "bleu": f"WITH {_BLEU} SELECT n, clipped::BIGINT AS clipped, total::BIGINT AS total, round(bleu, 6) AS bleu FROM bleu",
    "cider_d": f"WITH {_BLEU}, {_CIDER} SELECT grp, round(cider, 6) AS cider FROM cider",
    "caption_metrics": f"""WITH {_BLEU}, {_CIDER} SELECT (SELECT round(bleu, 6) FROM bleu WHERE n = 1) AS bleu_1, (SELECT round(bleu, 6) FROM bleu WHERE n = 2) AS bleu_2,
(SELECT round(bleu, 6) FROM bleu WHERE n = 3) AS bleu_3, (SELECT round(bleu, 6) FROM bleu WHERE n = 4) AS bleu_4, (SELECT round(avg(cider), 6) FROM cider) AS cider""",
    "token_accuracy": f"""WITH {_TURNS}, tk AS (
  SELECT conv_id, regexp_extract_all(lower(answer), '[a-z0-9'']+') AS a, regexp_extract_all(lower(question), '[a-z0-9'']+') AS q FROM pairs
), l AS (SELECT conv_id, coalesce(a[i], '') AS t, coalesce(q[i], '') AS p FROM (SELECT conv_id, a, q, unnest(generate_series(1, greatest(len(a), len(q), 1))) AS i FROM tk))
SELECT conv_id, round(CASE WHEN sum((t <> '')::INT) = 0 THEN 0 ELSE sum((t <> '' AND t = p)::INT)::DOUBLE / sum((t <> '')::INT) END, 6) AS accuracy FROM l GROUP BY conv_id""",
    "normalize_vector": f"WITH {_VEC}, {_LONG.format('vec')} SELECT vec_id, dim, round((v - 0.485::DOUBLE) / 0.229::DOUBLE, 6) AS value FROM long",
    "pairwise_self": f"""WITH {_VEC}, {_TOP} SELECT a.label, a.slot AS i, b.slot AS j,
  round(list_sum(list_transform(list_zip(a.x, b.x), lambda p: p[1] * p[2])), 6) AS score FROM top a JOIN top b USING (label)""",
    "log_softmax": f"""WITH {_VEC}, s AS (SELECT vec_id, x, {_LSE} AS lse FROM vec), l AS (SELECT vec_id, unnest(generate_series(0, len(x) - 1))::INT AS dim, unnest(x) AS v, lse FROM s)
SELECT vec_id, dim, round(v - lse, 6) AS value FROM l""",
    "topk_pad": f"""WITH {_VEC}, k AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS slot FROM vec),
s AS (SELECT DISTINCT label, unnest(generate_series(0, {q.SLOTS - 1})) AS slot FROM vec)
SELECT s.label, s.slot::INT AS slot, coalesce(vec_id, -1) AS vec_id, vec_id IS NULL AS is_pad, round(coalesce(list_sum(x), 0), 6) AS total FROM s LEFT JOIN k ON k.label = s.label AND k.slot = s.slot""",
    "attention_pool": f"WITH {_VEC}, {_QUERIED}, {_ATTEND.format(_DOT)}",
    "tanh_attention": f"WITH {_VEC}, {_QUERIED}, {_ATTEND.format(_TANH)}",
    "relation_mean": f"""WITH {_VEC}, {_TOP}, {_LONG.format('top')}
SELECT a.label, a.slot, a.dim, round(any_value(a.v) + avg(a.v * b.v), 6) AS value FROM long a JOIN long b ON a.label = b.label AND a.dim = b.dim GROUP BY a.label, a.slot, a.dim""",
    "mean_pool_tanh": f"WITH {_VEC}, {_LONG.format('vec')} SELECT label, dim, round(tanh(avg(v)), 6) AS value FROM long GROUP BY label, dim",
    "masked_mean": f"""WITH {_VEC}, e AS (SELECT label, min(vec_id) AS e FROM vec WHERE x[1] < -0.2 GROUP BY label),
k AS (SELECT vec.* FROM vec LEFT JOIN e USING (label) WHERE e IS NULL OR vec_id <= e), {_LONG.format('k')}
SELECT label, dim, round(avg(v), 6) AS value FROM long GROUP BY label, dim""",
    "argmax": f"WITH {_VEC} SELECT vec_id, (list_position(x, list_max(x)) - 1)::INT AS best FROM vec",
    "cross_entropy": f"""WITH {_VEC}, s AS (SELECT label, x, vec_id % {q.WIDTH} AS t, {_LSE} AS lse FROM vec WHERE vec_id % {q.WIDTH} <> 0)
SELECT label, round(avg(lse - x[t + 1]), 6) AS loss, round(avg((lse - x[t + 1]) * 0.9::DOUBLE + (lse - list_sum(x) / len(x)) * 0.1::DOUBLE), 6) AS smooth_loss FROM s GROUP BY label""",
    "ngram_block": f"""WITH tk AS (SELECT doc_id, {_TOKS} AS w FROM documents),
l AS (SELECT doc_id, w[i + 2] AS word FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 2)) AS i FROM tk WHERE len(w) >= 3) WHERE w[i] = w[len(w) - 1] AND w[i + 1] = w[len(w)]),
b AS (SELECT doc_id, count(DISTINCT word) AS n, string_agg(DISTINCT word, ' ' ORDER BY word) AS words FROM l GROUP BY doc_id)
SELECT tk.doc_id, coalesce(n, 0)::INT AS n, coalesce(words, '') AS words FROM tk LEFT JOIN b USING (doc_id)""",
    "beam_step": f"""WITH {_VEC}, {_TOP}, s AS (SELECT label, slot, x, {_LSE} AS lse FROM top WHERE slot < {q.BEAM}),
l AS (SELECT label, slot AS parent, unnest(generate_series(0, len(x) - 1))::INT AS token, unnest(x) AS v, lse FROM s),
c AS (SELECT label, parent, token, -parent / 10.0::DOUBLE + CASE WHEN parent = 2 THEN CASE WHEN token = 0 THEN 0 ELSE '-inf'::DOUBLE END ELSE v - lse END AS score FROM l)
SELECT label, (row_number() OVER w - 1)::INT AS nth, parent, token, round(score, 6) AS score FROM c WINDOW w AS (PARTITION BY label ORDER BY score DESC, parent, token) QUALIFY nth < {q.BEAM}""",
    "length_norm_pick": f"""WITH {_TEXTS}, n AS (SELECT grp, doc_id, (-len(toks) * 1.5::DOUBLE - doc_id % 7) / greatest(len(toks), 1)::DOUBLE ** 0.7::DOUBLE AS norm FROM texts)
SELECT grp, doc_id, round(norm, 6) AS norm FROM n QUALIFY row_number() OVER (PARTITION BY grp ORDER BY norm DESC, doc_id) = 1""",
    "eval_schedule": f"SELECT epoch, seen, epoch % 5 = 0 OR epoch = last AS evaluate FROM {_EPOCHS}",
    "ss_prob": f"SELECT epoch, seen, round(least(0.24::DOUBLE, (epoch // 4) * 0.06::DOUBLE), 6) AS probability FROM {_EPOCHS}",
    "lr_decay": f"SELECT epoch, seen, round(0.0005::DOUBLE * pow(0.6::DOUBLE, epoch // 4), 12) AS rate FROM {_EPOCHS}",
    "checkpoint_crossings": """WITH s AS (SELECT o_custkey, o_orderkey, o_orderkey % 700 + 1 AS samples, sum(o_orderkey % 700 + 1) OVER (PARTITION BY o_custkey ORDER BY o_orderkey)::BIGINT AS seen FROM orders)
SELECT o_custkey, o_orderkey, seen, seen // 500 - (seen - samples) // 500 AS saves, (seen // 500 + 1) * 500 AS next_at FROM s""",
    "best_so_far": """SELECT o_custkey, o_orderkey, max(o_totalprice) OVER w AS best,
  o_totalprice > coalesce(max(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '-inf'::DOUBLE) AS improved
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)""",
    "cache_hit_miss": """SELECT d.doc_id // 4 AS batch, count(*) AS n, count(l.doc_id) AS found, count(l.doc_id) = count(*) AS hit
FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels WHERE quality = 1) l USING (doc_id) GROUP BY 1""",
    "seeded_sample": f"SELECT doc_id, lang FROM documents ORDER BY {_DRAWN.format(42, 'doc_id')}, doc_id LIMIT 100",
    "shuffled_rows": f"SELECT doc_id, row_number() OVER (ORDER BY {_DRAWN.format(42, 'doc_id')}) - 1 AS place FROM documents",
    "batch_ids": f"SELECT lang, doc_id, (row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1) // {q.BATCH} AS batch FROM documents",
    "question_context": f"""WITH {_VEC}, ev AS (SELECT user_id AS c, event_id % (SELECT count(*) FROM embeddings) AS vec_id FROM events),
n AS (SELECT c, count(*) AS n FROM ev GROUP BY c), w AS (SELECT c, n, max(n) OVER (PARTITION BY c // {q.BATCH}) AS w FROM n),
ids AS (SELECT c, vec_id FROM ev UNION ALL SELECT c, 0 FROM (SELECT c, unnest(generate_series(1, w - n)) FROM w)),
{_LONG.format('vec')}, m AS (SELECT c, dim, avg(v) AS m FROM ids JOIN long USING (vec_id) GROUP BY c, dim)
SELECT c_custkey, d.dim, round(coalesce(m, 0), 6) + 0 AS value FROM customer, (SELECT unnest(generate_series(0, {q.WIDTH - 1}))::INT AS dim) d LEFT JOIN m ON c = c_custkey AND m.dim = d.dim""",
    "split_batches": f"""WITH t AS (SELECT conv_id * 100 + turn AS sample, conv_id, {_TOKS} AS ws FROM conversations WHERE role = 'assistant'),
voc AS (SELECT word, row_number() OVER (ORDER BY word) + 3 AS id FROM (SELECT unnest(ws) AS word FROM t WHERE conv_id % 10 <> 0) GROUP BY word HAVING count(*) >= 2),
v AS (SELECT sample, ws[1:{q.MOST_TOKENS - 2}] AS ws, (row_number() OVER (ORDER BY sample) - 1) // 8 AS batch FROM t WHERE conv_id % 10 = 0),
l AS (SELECT sample, unnest(generate_series(1, len(ws))) AS pos, unnest(ws) AS word FROM v),
g AS (SELECT sample, list(coalesce(id, 3) ORDER BY pos) AS own FROM l LEFT JOIN voc USING (word) GROUP BY sample),
e AS (SELECT v.sample, batch, list_concat([1::BIGINT], coalesce(own, []), [2::BIGINT]) AS ids FROM v LEFT JOIN g USING (sample)),
w AS (SELECT *, max(len(ids)) OVER (PARTITION BY batch) AS w FROM e)
SELECT sample, batch, array_to_string(list_concat(ids, list_transform(generate_series(1, w - len(ids)), lambda x: 0::BIGINT)), ' ') AS ids FROM w""",
    "sample_report": f"""WITH {_LISTS}, s AS (SELECT grp, list_max(ids) AS doc_id, ids FROM lists ORDER BY {_DRAWN.format(7, 'grp')}, grp LIMIT 20)
SELECT grp, 'about ' || doc_id AS predicted, ids[1] AS first_caption, ids[5] AS fifth_caption FROM s""",
    "sample_run": f"""WITH {CAPTIONS}, l AS (SELECT image_id, list(caption ORDER BY question_id) AS c FROM captions GROUP BY image_id)
SELECT image_id, upper(c[-1]) AS predicted, c[1] AS first_caption, c[5] AS fifth_caption FROM l ORDER BY {_DRAWN.format(11, 'image_id')}, image_id LIMIT 30""",
    "latest_state": "SELECT o_custkey, max(o_orderkey) AS samples_seen, arg_max(o_totalprice, o_orderkey) AS best FROM orders GROUP BY o_custkey",
    "matching_entries": """SELECT p_partkey, 'w' || (p_partkey % 40) AS name, p_size AS shape FROM part
WHERE p_partkey % 3 <> 0 AND (p_partkey % 40, p_size) IN (SELECT (n_nationkey, n_regionkey * 10 + 1) FROM nation)""",
    "fuse_mul": _fused("list_transform(list_zip(x, query), lambda p: p[1] * p[2])"),
    "fuse_add": _fused("list_transform(list_zip(x, query), lambda p: p[1] + p[2])"),
    "fuse_concat": _fused("list_concat(x, query)"),
}
