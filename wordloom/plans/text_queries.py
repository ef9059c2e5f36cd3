"""Queries of the text functions, each over its whole table, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from wordloom.functions import text as X
from wordloom.profiles import ARABIC as A
from wordloom.session import table

M, V, O_ = A.marks, A.vowels, A.other_marks  # noqa: N816
MARKUP = [r"<[^>]*>", r"\]\([^)]*\)", r"https?://\S+", r"#[^\s#]+", r"[\[\]*|_]+"]
STOP = ["the", "and", "for", "with", "from", "that"]


def _surface(*cols):
    """One row an entry and spelling: repeated deliveries fall together."""

    def make(spark, d):
        return table(spark, d, "surface").select("match_id", *cols).distinct()

    return make


def _q(rows, **outs):
    return lambda spark, d: rows(spark, d).select("match_id", *[f().alias(n) for n, f in outs.items()])


QUERIES, ORACLE = {}, {}


def add(name, fn, sql=None):
    QUERIES[name] = fn
    if sql:
        ORACLE[name] = sql


def _sql_surface(cols, outs):
    return f"WITH s AS (SELECT DISTINCT match_id, {cols} FROM surface) SELECT match_id, {outs} FROM s"


DEDIAC = f"translate({{}}, '{A.strip}', '')"
FOLD = f"translate({{}}, '{A.fold[0]}{A.strip}', '{A.fold[1]}')"
LET = f"regexp_extract_all(translate({{}}, '{A.stretch}', ''), '([^{M}])[{M}]*', 1)"
MRK = f"regexp_extract_all(translate({{}}, '{A.stretch}', ''), '[^{M}]([{M}]*)', 1)"

add("dediac", _q(_surface("vocalized"), bare=lambda: X.dediac("vocalized")), _sql_surface("vocalized", DEDIAC.format("vocalized") + " AS bare"))
add(
    "fold_key",
    _q(_surface("vocalized", "search_key"), folded=lambda: X.fold_key("vocalized"), same=lambda: X.fold_key("vocalized") == F.col("search_key")),
    _sql_surface("vocalized, search_key", f"{FOLD.format('vocalized')} AS folded, {FOLD.format('vocalized')} = search_key AS same"),
)
add(
    "root_key",
    _q(_surface("root"), root_key=lambda: X.root_key("root")),
    _sql_surface("root", f"regexp_replace(translate({FOLD.format('root')}, 'ء', 'ا'), '[^ء-ي]', '', 'g') AS root_key"),
)
add("fold_hamza", _q(_surface("root"), folded=lambda: X.fold_hamza("root")), _sql_surface("root", "regexp_replace(translate(root, 'أإآؤئ', 'ءءءءء'), '^ا', 'ء') AS folded"))
add(
    "stable_id",
    _q(_surface("search_key", "vocalized"), id=lambda: X.stable_id("search_key", "vocalized")),
    _sql_surface("search_key, vocalized", "search_key || '#' || left(sha1(vocalized), 6) AS id"),
)
_ONCE = "list_filter({0}, lambda x, i: list_position({0}, x) = i)"
_GEM = "[r] || CASE WHEN length(r) = 3 AND r[2] = r[3] THEN [r[1:2]] ELSE [] END || CASE WHEN length(r) = 3 AND r[1] = r[2] THEN [r[2:3]] ELSE [] END"
_WEAK = f"flatten(list_transform(g, lambda r: [r] || list_transform(list_filter(['{"', '".join(A.weak_ends)}'], lambda b: right(r, 1) IN ('{"', '".join(A.weak_ends)}') AND b <> right(r, 1)), lambda b: left(r, length(r) - 1) || b)))"
_SEAT = f"flatten(list_transform(w, lambda r: [r] || flatten(list_transform(list_filter(range(1, length(r) + 1), lambda i: contains('{A.seats}', r[i])), lambda i: list_transform(list_filter(string_split('{A.seats}', ''), lambda s: s <> r[i]), lambda s: r[1:i - 1] || s || r[i + 1:])))))"
add(
    "root_variants",
    lambda s, d: table(s, d, "surface").select("root").distinct().select("root", F.array_join(X.root_variants(X.root_key("root")), "|").alias("variants")),
    f"""WITH k AS (SELECT DISTINCT root, regexp_replace(translate({FOLD.format('root')}, 'ء', 'ا'), '[^ء-ي]', '', 'g') AS r FROM surface), g AS (SELECT root, r, {_GEM} AS g FROM k),
w AS (SELECT root, r, {_WEAK} AS w FROM g), v AS (SELECT root, r, list_filter({_SEAT}, lambda x: x <> '') AS v FROM w) SELECT root, CASE WHEN r IS NOT NULL THEN array_to_string({_ONCE.format('v')}, '|') END AS variants FROM v""",
)
add(
    "split_marks",
    _q(_surface("vocalized"), letters=lambda: F.array_join(X.letters("vocalized"), ""), marks=lambda: F.array_join(X.letter_marks("vocalized"), "|")),
    _sql_surface("vocalized", f"array_to_string({LET.format('vocalized')}, '') AS letters, array_to_string({MRK.format('vocalized')}, '|') AS marks"),
)
add(
    "mark_class",
    _q(_surface("vocalized", "unvocalized"), voc=lambda: X.mark_class("vocalized"), unvoc=lambda: X.mark_class("unvocalized")),
    _sql_surface(
        "vocalized, unvocalized",
        ", ".join(
            f"CASE WHEN {c} IS NULL THEN NULL WHEN NOT regexp_matches(translate({c}, '{A.stretch}', ''), '[^{M}][{M}]') THEN 'none' "
            f"WHEN regexp_matches(translate({c}, '{A.stretch}', ''), '[{V}][{O_}]*$') THEN 'full' ELSE 'partial' END AS {n}"
            for c, n in (("vocalized", "voc"), ("unvocalized", "unvoc"))
        ),
    ),
)
add(
    "final_vowel",
    _q(_surface("vocalized"), ending=lambda: X.ending_vowel("vocalized"), last=lambda: X.last_vowel("vocalized")),
    _sql_surface(
        "vocalized", f"nullif(regexp_extract(translate(vocalized, '{A.stretch}', ''), '([{V}])[{O_}]*$', 1), '') AS ending, nullif(regexp_extract(vocalized, '^.*([{V}])', 1), '') AS last"
    ),
)
_PAIR = f"(SELECT match_id, {LET.format('unvocalized')} la, {LET.format('vocalized')} lb, {MRK.format('unvocalized')} ma, {MRK.format('vocalized')} mb, unvocalized, vocalized FROM (SELECT DISTINCT match_id, unvocalized, vocalized FROM surface))"
_SETS = "list_transform({}, lambda m: list_sort(list_distinct(string_split(m, ''))))"
add(
    "consistent_filter",
    _q(_surface("unvocalized", "vocalized"), ok=lambda: X.is_consistent("unvocalized", "vocalized")),
    f"SELECT match_id, la = lb AND len(list_filter(range(1, len(ma) + 1), lambda i: len(list_filter(string_split(ma[i], ''), lambda x: x <> '' AND NOT contains(mb[i], x))) > 0)) = 0 AS ok FROM {_PAIR}",
)
add(
    "mark_agreement",
    _q(_surface("unvocalized", "vocalized"), ok=lambda: X.agrees("unvocalized", "vocalized")),
    f"SELECT match_id, la = lb AND {_SETS.format('ma')} = {_SETS.format('mb')} AS ok FROM {_PAIR}",
)
add(
    "transfer_marks",
    _q(_surface("unvocalized", "vocalized"), worn=lambda: X.transfer_marks("unvocalized", "vocalized")),
    f"SELECT match_id, CASE WHEN len(la) = len(lb) THEN array_to_string(list_transform(range(1, len(la) + 1), lambda i: CASE WHEN la[i] = lb[i] THEN la[i] || mb[i] ELSE la[i] END), '') ELSE unvocalized END AS worn FROM {_PAIR}",
)
_HM = X.HEADWORD_MARKS
add(
    "voc_key",
    _q(_surface("vocalized"), voc_key=lambda: X.voc_key("vocalized")),
    rf"""WITH s AS (SELECT DISTINCT match_id, vocalized FROM surface), g AS (SELECT match_id, vocalized, regexp_extract_all(vocalized, '([^\s{_HM}])[{_HM}]*', 1) l, regexp_extract_all(vocalized, '[^\s{_HM}]([{_HM}]*)', 1) m FROM s)
SELECT match_id, array_to_string(list_transform(range(1, len(l) + 1), lambda i: l[i] || CASE WHEN i = len(l) THEN regexp_replace(m[i], '[^ّ]', '', 'g') ELSE array_to_string(list_sort(string_split(m[i], '')), '') END), '') AS voc_key FROM g""",
)
add(
    "short_lemma_flag",
    _q(_surface("pos", "root", "lemma", "vocalized"), flag=lambda: X.short_lemma("pos", "root", "lemma", "vocalized")),
    "WITH s AS (SELECT DISTINCT match_id, pos, root, lemma, vocalized FROM surface) SELECT match_id, coalesce(pos = 'particle' AND coalesce(root, '') = '' AND coalesce(lemma, '') <> '' "
    f"AND length({FOLD.format('vocalized')}) > 0 AND length({FOLD.format('lemma')}) / length({FOLD.format('vocalized')}) < 0.30, false) AS flag FROM s",
)
add(
    "null_reason",
    _q(_surface("pos", "root", "lemma", "vocalized"), reason=lambda: X.null_reason("root", "pos", X.short_lemma("pos", "root", "lemma", "vocalized"))),
    "WITH s AS (SELECT DISTINCT match_id, pos, root, lemma, vocalized FROM surface) SELECT match_id, CASE WHEN coalesce(root, '') <> '' THEN 'present' WHEN coalesce(pos = 'particle' AND coalesce(lemma, '') <> '' "
    f"AND length({FOLD.format('vocalized')}) > 0 AND length({FOLD.format('lemma')}) / length({FOLD.format('vocalized')}) < 0.30, false) THEN 'suspect' WHEN pos IN ('particle', 'name') THEN 'by_design' ELSE 'missing' END AS reason FROM s",
)
add(
    "parse_counts",
    _q(_surface("voc_source", "layers"), lexicon=lambda: X.count_under(X.parse_counts("voc_source"), "lexicon"), aligned=lambda: X.count_under(X.parse_counts("voc_source"), "aligned"), matn=lambda: X.parse_counts("layers")["matn"]),
    r"WITH s AS (SELECT DISTINCT match_id, voc_source, layers FROM surface) SELECT match_id, CAST(CASE WHEN voc_source IS NULL THEN NULL ELSE coalesce(list_sum(list_transform(regexp_extract_all(voc_source, 'lexicon[^:,]*:(\d+)', 1), lambda x: x::INT)), 0) END AS INTEGER) AS lexicon, "
    r"CAST(CASE WHEN voc_source IS NULL THEN NULL ELSE coalesce(list_sum(list_transform(regexp_extract_all(voc_source, 'aligned[^:,]*:(\d+)', 1), lambda x: x::INT)), 0) END AS INTEGER) AS aligned, "
    r"CAST(nullif(regexp_extract(layers, '(?:^|,)matn:(\d+)', 1), '') AS INTEGER) AS matn FROM s",
)
add(
    "parse_candidates",
    lambda s, d: table(s, d, "surface")
    .where("search_key is not null and vocalized is not null and freq is not null")
    .groupBy("search_key", "vocalized")
    .agg(F.max("freq").alias("n"))
    .groupBy("search_key")
    .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("vocalized", "n"))), lambda x: F.concat(x["vocalized"], F.lit("("), x["n"].cast("string"), F.lit(")"))), " | ").alias("review"))
    .select("search_key", F.explode(X.parse_candidates("review")).alias("c"))
    .select("search_key", F.col("c.form").alias("form"), F.col("c.n").alias("n")),
    "SELECT search_key, trim(vocalized, ' ') AS form, CAST(max(freq) AS INTEGER) AS n FROM surface WHERE search_key IS NOT NULL AND vocalized IS NOT NULL AND freq IS NOT NULL GROUP BY search_key, vocalized",
)
#: A slot that stands in this part of the glosses of several slots is an affix: at most AFFIX_PART times as many affixes
#: as a gloss has slots, whatever the data.
AFFIX_PART = 10
PRONOUNS = r"^(?i:i|we|you|he|she|it|they|them|us|me|him|her|its?|my|our|your|their)\b"


def gloss_affixes(rows, gloss):
    """The names of the slots that stand beside many others, as a one-row array."""
    several = rows.select(gloss).where(F.col(gloss).contains(" + ")).distinct()
    names = several.select(gloss, F.explode(X.gloss_slots(gloss)).alias("x")).select(gloss, X.slot_name(F.col("x")).alias("name")).where("name <> ''").distinct()
    total = several.agg(F.count(F.lit(1)).alias("n")).scalar()
    return names.groupBy("name").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") * AFFIX_PART >= total).agg(F.collect_list("name").alias("names"))


def _glosses(s, d):
    rows = _surface("gloss_msa")(s, d)
    listed = rows.withColumn("affixes", gloss_affixes(rows, "gloss_msa").scalar())
    g = listed.withColumn("g", X.parse_gloss("gloss_msa", F.col("affixes"), PRONOUNS))
    return g.where("g is not null").select(
        "match_id", F.array_join("g.senses", ";").alias("senses"), F.array_join("g.features", ".").alias("features"), F.array_join("g.before", "|").alias("before"), F.array_join("g.after", "|").alias("after"), F.col("g.stem_pos").alias("stem_pos")
    )


_TOLD = "list_filter(list_transform({}, lambda y: trim(y)), lambda y: y <> '')"
_PLAIN = r"trim(regexp_replace(regexp_replace(s, '<[^>]+>|\[[^\]]*\]', ' ', 'g'), '\s+', ' ', 'g'))"
_SENSES = _TOLD.format(f"string_split(CASE WHEN {_PLAIN} <> '___' THEN {_PLAIN} ELSE '' END, ';')")
_FEATS = _TOLD.format(r"string_split(array_to_string(regexp_extract_all(s, '\[([^\]]*)\]', 1), '.'), '.')")
_SLOTS = f"list_transform(string_split(trim(gloss_msa), ' + '), lambda s: {{{{'n': {_SENSES}, 'f': {_FEATS}, 'p': nullif(regexp_extract(s, '<([^>]+)>', 1), '')}}}})".replace("{{", "{").replace("}}", "}")
_NAME = "array_to_string({}.n, ';')"
_ALONE = rf"(len(l[i].n) = 1 AND regexp_matches(l[i].n[1], '{PRONOUNS}') AND (l[i].p IS NOT NULL OR len(string_split(l[i].n[1], ' ')) <= 2))"
add(
    "parse_gloss",
    _glosses,
    f"""WITH r AS (SELECT DISTINCT match_id, gloss_msa FROM surface WHERE gloss_msa IS NOT NULL), q AS (SELECT match_id, gloss_msa, {_SLOTS} AS l FROM r),
several AS (SELECT DISTINCT gloss_msa, l FROM q WHERE contains(gloss_msa, ' + ')), nm AS (SELECT DISTINCT gloss_msa, {_NAME.format('u')} AS nm FROM (SELECT gloss_msa, unnest(l) AS u FROM several)),
af AS (SELECT coalesce(list(nm), []) AS af FROM (SELECT nm, count(*) AS n FROM nm WHERE nm <> '' GROUP BY nm) WHERE n * {AFFIX_PART} >= (SELECT count(*) FROM several)),
t AS (SELECT q.*, list_filter(range(1, len(l) + 1), lambda i: len(l[i].n) > 0) AS told, af FROM q, af),
k AS (SELECT *, list_filter(told, lambda i: NOT (list_contains(af, {_NAME.format('l[i]')}) OR {_ALONE})) AS stems FROM t),
w AS (SELECT match_id, l, CASE WHEN len(stems) > 0 THEN stems[1] ELSE list_sort(list_transform(told, lambda i: {{'a': length({_NAME.format('l[i]')}), 'i': i}}))[-1].i END AS sp FROM k WHERE len(told) > 0)
SELECT match_id, {_NAME.format('l[sp]')} AS senses, array_to_string(flatten(list_transform(l, lambda x: x.f)), '.') AS features,
array_to_string(list_filter(list_transform(l[1:sp - 1], lambda x: {_NAME.format('x')}), lambda x: x <> ''), '|') AS before,
array_to_string(list_filter(list_transform(l[sp + 1:], lambda x: {_NAME.format('x')}), lambda x: x <> ''), '|') AS after, l[sp].p AS stem_pos FROM w""",
)
add(
    "keyword_clean",
    _q(_surface("classical_keywords"), words=lambda: F.array_join(X.keywords("classical_keywords", STOP), "|")),
    "WITH s AS (SELECT DISTINCT match_id, classical_keywords k FROM surface) SELECT match_id, array_to_string(list_filter(list_transform(string_split_regex(k, '[,;]'), lambda x: lower(trim(x))), "
    rf"lambda x: length(x) > 2 AND regexp_full_match(x, '\p{{L}}+') AND x NOT IN ({', '.join(repr(w) for w in STOP)})), '|') AS words FROM s",
)
add(
    "fnv1a_shard",
    lambda s, d: table(s, d, "surface").select("search_key").where("search_key is not null").distinct().select("search_key", X.fnv1a("search_key").alias("hash"), (X.fnv1a("search_key") % 64).alias("shard")),
    "WITH k AS (SELECT DISTINCT search_key FROM surface WHERE search_key IS NOT NULL), h AS (SELECT search_key, list_reduce(list_prepend(2166136261::BIGINT, list_transform(range(0, octet_length(encode(search_key))), "
    "lambda i: ('0x' || substr(hex(encode(search_key)), 2 * i + 1, 2))::BIGINT)), lambda a, b: (xor(a, b) * 16777619) & 4294967295) h FROM k) SELECT search_key, h AS hash, h % 64 AS shard FROM h",
)
add(
    "root_shape",
    _q(_surface("lane_root"), geminate=lambda: X.is_geminate("lane_root"), hollow=lambda: X.is_hollow("lane_root")),
    _sql_surface("lane_root", "length(lane_root) = 3 AND substr(lane_root, 2, 1) = substr(lane_root, 3, 1) AS geminate, length(lane_root) = 3 AND regexp_matches(substr(lane_root, 2, 1), '[وي]') AS hollow"),
)
add(
    "wildcard_match",
    _q(_surface("root", "lane_root"), ok=lambda: X.wildcard_match(F.regexp_replace(X.root_key("root"), "[وي]", "#"), X.root_key("lane_root"))),
    "WITH s AS (SELECT DISTINCT match_id, root, lane_root FROM surface), k AS (SELECT match_id, "
    + ", ".join(f"regexp_replace(translate({FOLD.format(c)}, 'ء', 'ا'), '[^ء-ي]', '', 'g') {n}" for c, n in (("root", "a"), ("lane_root", "b")))
    + " FROM s) SELECT match_id, length(a) = length(b) AND len(list_filter(range(1, length(a) + 1), lambda i: substr(regexp_replace(a, '[وي]', '#', 'g'), i, 1) NOT IN ('#', substr(b, i, 1)))) = 0 AS ok FROM k",
)


# Records and documents
def _records(spark, d):
    """Of a record the latest row (the SQL's rule; ties are exact duplicates)."""
    from wordloom.session import latest_by

    return latest_by(table(spark, d, "records"), ["id"], "loaded_at", ["corpus", "layer", "record_type", "number", "seq", "kitab", "bab", "pages", "textraw", "prev_id", "next_id", "crossrefs", "numberscovered", "tokens", "zawaidnote"])


REC = "rec AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC NULLS LAST) rn FROM records) WHERE rn = 1)"
W = f"[{A.letters}{A.strip}]"
NW = f"[^{A.letters}{A.strip}]"


def _tokens(spark, d):
    return _records(spark, d).select("id", F.posexplode(X.tokens_of("textraw")).alias("i", "t")).select("id", "i", F.col("t.raw").alias("raw"), F.col("t.after").alias("after"))


TOK = f"tok AS (SELECT id, corpus, layer, seq, CAST(i - 1 AS INTEGER) AS i, raws[i] AS raw, afters[i] AS after FROM (SELECT id, corpus, layer, seq, raws, afters, unnest(range(1, len(raws) + 1)) AS i FROM (SELECT id, corpus, layer, seq, regexp_extract_all(textraw, '({W}+){NW}*', 1) raws, regexp_extract_all(textraw, '{W}+({NW}*)', 1) afters FROM rec)))"
add("tokenise", _tokens, f"WITH {REC}, {TOK} SELECT id, i, raw, after FROM tok")
add(
    "roundtrip_check",
    lambda s, d: _records(s, d).select("id", (X.reconstruct(X.leading_of("textraw"), X.tokens_of("textraw")) == F.col("textraw")).alias("exact")),
    f"WITH {REC} SELECT id, CASE WHEN textraw IS NULL THEN NULL ELSE true END AS exact FROM rec",
)
add(
    "count_tokens",
    lambda s, d: _records(s, d).select("id", X.count_words("textraw").alias("words"), F.size(X.tokens_of("textraw")).alias("tokens")),
    rf"WITH {REC} SELECT id, CAST(len(list_filter(string_split_regex(textraw, '\s+'), lambda w: regexp_matches(w, '[{A.letters}]'))) AS INTEGER) AS words, CAST(len(regexp_extract_all(textraw, '{W}+')) AS INTEGER) AS tokens FROM rec",
)
add(
    "page_marks",
    lambda s, d: _records(s, d).select("id", F.array_join(X.page_marks(F.array_join("pages", " "), r"V(\d+)P(\d+)"), " ").alias("pages")),
    rf"""WITH {REC}, p AS (SELECT id, array_to_string(pages, ' ') t FROM rec), m AS (SELECT id, regexp_extract_all(t, 'V(\d+)P(\d+)', 1) v, regexp_extract_all(t, 'V(\d+)P(\d+)', 2) p FROM p),
l AS (SELECT id, list_filter(list_transform(range(1, len(v) + 1), lambda i: (v[i]::INT)::VARCHAR || ':' || (p[i]::INT)::VARCHAR), lambda x: x <> '0:0') l FROM m)
SELECT id, array_to_string(list_filter(list_transform(range(1, len(l) + 1), lambda i: CASE WHEN list_position(l, l[i]) = i THEN l[i] END), lambda x: x IS NOT NULL), ' ') AS pages FROM l""",
)
_doc = lambda s, d: table(s, d, "documents").select("doc_id", "text")
_SQLM = "text"
for _rx in MARKUP:
    _SQLM = f"regexp_replace({_SQLM}, '{_rx}', ' ', 'g')"
WS = r"[ \t\n\x0B\f\r]+"
add(
    "strip_markup",
    lambda s, d: _doc(s, d).select("doc_id", F.length(X.strip_markup("text", MARKUP)).alias("n"), F.md5(X.strip_markup("text", MARKUP)).alias("h")),
    rf"WITH t AS (SELECT doc_id, trim(regexp_replace({_SQLM}, '{WS}', ' ', 'g')) s FROM documents) SELECT doc_id, CAST(length(s) AS INTEGER) AS n, md5(s) AS h FROM t",
)
add(
    "residual_markers",
    lambda s, d: _doc(s, d).select("doc_id", X.strip_markup("text", MARKUP[:2]).alias("t")).select("doc_id", F.explode(F.array(*[F.struct(F.lit(i).alias("pattern"), F.col("t").rlike(rx).alias("hit")) for i, rx in enumerate(MARKUP)])).alias("p")).where("p.hit").groupBy(F.col("p.pattern").alias("pattern")).agg(F.count(F.lit(1)).alias("documents"), F.min("doc_id").alias("first")),
    "WITH t AS (SELECT doc_id, regexp_replace(regexp_replace(text, '" + MARKUP[0] + "', ' ', 'g'), '" + MARKUP[1] + "', ' ', 'g') t FROM documents) "
    + " UNION ALL ".join(f"SELECT {i} AS pattern, count(*) AS documents, min(doc_id) AS first FROM t WHERE regexp_matches(t, '{rx}') HAVING count(*) > 0" for i, rx in enumerate(MARKUP)),
)
add(
    "opener_numbers",
    lambda s, d: _doc(s, d).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "t")).select("doc_id", "line", X.opener_numbers("t").alias("n"), X.opener_rest("t").alias("rest")).where(F.size("n") > 0).select("doc_id", "line", F.array_join(F.transform("n", lambda x: x.cast("string")), ",").alias("numbers"), F.md5("rest").alias("rest")),
    r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) t, generate_subscripts(string_split(text, chr(10)), 1) - 1 line FROM documents),
n AS (SELECT doc_id, line, regexp_extract(t, '^((?:[0-9]+[ \t\n\x0B\f\r]*-[ \t\n\x0B\f\r]*)+)', 1) c, regexp_replace(t, '^(?:[0-9]+[ \t\n\x0B\f\r]*-[ \t\n\x0B\f\r]*)+', '') rest FROM l)
SELECT doc_id, CAST(line AS INTEGER) AS line, array_to_string(list_transform(regexp_extract_all(c, '([0-9]+)', 1), lambda x: (x::INT)::VARCHAR), ',') AS numbers, md5(rest) AS rest FROM n WHERE c <> ''""",
)
add(
    "cross_refs",
    lambda s, d: _doc(s, d).where("text is not null").select("doc_id", F.array_join(F.transform(X.numbers_in("text", r"\(([0-9, ]{1,9})\)"), lambda x: x.cast("string")), ",").alias("refs")).where("refs <> ''"),
    r"WITH r AS (SELECT doc_id, array_to_string(list_transform(regexp_extract_all(regexp_extract(text, '\(([0-9, ]{1,9})\)', 1), '([0-9]+)', 1), lambda x: (x::INT)::VARCHAR), ',') refs FROM documents WHERE text IS NOT NULL) SELECT * FROM r WHERE refs <> ''",
)
_RUN, _OTH = A.run_marks, "".join(m for m in A.run_marks if m not in A.plain_vowels)
_FORMS = f"translate(text, '{A.letter_forms[0]}', '{A.letter_forms[1]}')"
# A stretch ends at a character outside the block; RE2 has no look-ahead, so that character is captured and put back.
_LED = f"regexp_replace({_FORMS}, '({A.kasra}[{_OTH}]*)[{A.placed_yeh}]([{_RUN}]*)([^\u0600-\u06ff]|$)', '\\1{A.yeh_dotted}\\2\\3', 'g')"
_LAST = f"regexp_replace({_LED}, '[{A.placed_yeh}]([{_RUN}]*)([^\u0600-\u06ff]|$)', '{A.yeh_bare}\\1\\2', 'g')"
add(
    "context_fold",
    lambda s, d: _doc(s, d).select("doc_id", F.md5(X.context_fold("text")).alias("h")),
    f"SELECT doc_id, md5(translate({_LAST}, '{A.placed_yeh}', '{A.yeh_dotted * len(A.placed_yeh)}')) AS h FROM documents",
)
add(
    "cluster_check",
    lambda s, d: _surface("gloss_msa")(s, d).select("match_id", X.cluster_plausible(F.regexp_extract("gloss_msa", "([A-Za-z]+)$", 1)).alias("ok")),
    "WITH s AS (SELECT DISTINCT match_id, gloss_msa FROM surface), w AS (SELECT match_id, lower(regexp_extract(gloss_msa, '([A-Za-z]+)$', 1)) w FROM s) SELECT match_id, coalesce(NOT regexp_matches(w, '^[b-df-hj-np-tv-z][b-df-hj-np-tv-z]') AND NOT regexp_matches(w, '[b-df-hj-np-tv-z]{3}'), true) AS ok FROM w",
)
