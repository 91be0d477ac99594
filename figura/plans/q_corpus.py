"""Driver queries: joins and unions of the corpus, context selection,
ancestor lookup, fragments, sentence lookup, offset repair, arguments.

Conversations stand in for the discourse hierarchy: a conversation is a
document (fragment ``div`` level 1), two consecutive turns an exchange
(``div`` level 2), a user turn an utterance ``u``, any other turn a
paragraph ``p``, and each line of a turn a sentence ``s``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from figura.functions import text as T
from figura.functions.hashing import bucket
from figura.functions.ids import two_digits
from figura.operators import arguments, context, corpus
from figura.operators.occurrences import first_occurrences
from figura.plans.catalog import register
from figura.plans.q_features import drawn_word, sql_drawn_word
from figura.plans.q_text import SQL_NORM, SQL_STRIP, SQL_WORD_TOKENS, SQL_WS_TOKENS
from figura.plans.tables import read, read_spread, sql_bucket
from figura.session import staged

NL = "chr(10)"


# ------------------------------------------------------------- joins, unions

def label_join(spark, sf_dir):
    """Index (documents) joined with gold labels on the example id."""
    index = read(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), F.col("lang").alias("genre"), "source", "n_chars")
    labels = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"),
                                                  F.col("quality").alias("y"))
    return corpus.join_labels(index, labels)


register("label_join", """
SELECT d.doc_id AS id, d.lang AS genre, d.source, d.n_chars, l.quality AS y
FROM documents d JOIN labels l ON d.doc_id = l.doc_id
""")(label_join)


def _lemma(c, key):
    return F.nullif(drawn_word(T.word_tokens(c), "lemma", key), F.lit(""))     # null when the text has no word


def lemma_join_union(spark, sf_dir):
    """Train (labelled documents) and test (benchmark items) examples joined
    with the union of two lemma sources; examples without a lemma drop."""
    docs = read(spark, sf_dir, "documents")
    bench = read(spark, sf_dir, "benchmark")
    labels = read(spark, sf_dir, "labels")
    doc_id = F.concat(F.lit("doc_"), F.col("doc_id").cast("string"))
    bench_id = F.concat(F.lit("bench_"), F.col("item_id").cast("string"))
    train = labels.select(doc_id.alias("id"), F.col("quality").alias("y"))
    test = bench.select(bench_id.alias("id"), F.lit(None).cast("int").alias("y"))
    lem_a = docs.select(doc_id.alias("id"), _lemma("text", "doc_id").alias("verb_lemma"))
    lem_b = bench.select(bench_id.alias("id"), _lemma("text", "item_id").alias("verb_lemma"))
    return corpus.join_lemmas(train.unionByName(test), lem_a, lem_b)


register("lemma_join_union", f"""
WITH ex AS (
  SELECT 'doc_' || CAST(doc_id AS VARCHAR) AS id, quality AS y FROM labels
  UNION ALL
  SELECT 'bench_' || CAST(item_id AS VARCHAR), CAST(NULL AS INTEGER) FROM benchmark
), lem AS (
  SELECT 'doc_' || CAST(doc_id AS VARCHAR) AS id, nullif({sql_drawn_word(SQL_WORD_TOKENS.format('text'), 'lemma', 'doc_id')}, '') AS verb_lemma
  FROM documents
  UNION ALL
  SELECT 'bench_' || CAST(item_id AS VARCHAR), nullif({sql_drawn_word(SQL_WORD_TOKENS.format('text'), 'lemma', 'item_id')}, '') FROM benchmark
)
SELECT ex.id, ex.y, lem.verb_lemma FROM ex JOIN lem ON ex.id = lem.id
""")(lemma_join_union)


def train_test_union(spark, sf_dir):
    """Train and test example tables with different columns, unioned by
    name; the test side gets constant partition/offset columns."""
    docs = read(spark, sf_dir, "documents")
    labels = read(spark, sf_dir, "labels")
    bench = read(spark, sf_dir, "benchmark")
    train = (docs.join(labels, "doc_id")
             .select(F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("id"),
                     F.col("quality").alias("y"), F.col("lang").alias("genre"),
                     F.lit("train").alias("partition"),
                     bucket(F.col("doc_id"), 5).cast("int").alias("fold_no"),
                     F.lit(1).alias("sentence_offset")))
    test = bench.select(F.concat(F.lit("bench_"), F.col("item_id").cast("string")).alias("id"),
                        F.lit("test").alias("partition"),
                        F.lit(0).alias("sentence_offset"), F.lit(0).alias("subword_offset"),
                        F.lit(0).alias("fold_no"))
    return corpus.union_examples(train, test)


register("train_test_union", f"""
SELECT 'doc_' || CAST(d.doc_id AS VARCHAR) AS id, l.quality AS y, d.lang AS genre,
       'train' AS partition, CAST({sql_bucket("CAST(d.doc_id AS VARCHAR)", 5)} AS INTEGER) AS fold_no,
       1 AS sentence_offset
FROM documents d JOIN labels l ON d.doc_id = l.doc_id
UNION ALL BY NAME
SELECT 'bench_' || CAST(item_id AS VARCHAR) AS id, 'test' AS partition, 0 AS sentence_offset,
       0 AS subword_offset, 0 AS fold_no
FROM benchmark
""")(train_test_union)


# ------------------------------------------------------------- contexts

def smallest_context(spark, sf_dir):
    """Smallest enclosing context of every line of every turn: its kind and
    digest, and the line's span inside it.

    Turns are compared with their exchange and conversation by length; only
    texts that win are kept, once each, and meet all their lines at once."""
    conv = read(spark, sf_dir, "conversations").withColumn("exchange", F.floor(F.col("turn") / 2).cast("bigint"))
    own = F.when(F.col("role") == "user", F.lit("utterance")).otherwise(F.lit("paragraph"))
    null = F.lit(None).cast("bigint")
    turns = conv.select("conv_id", own.alias("kind"), F.col("turn").cast("bigint").alias("unit"), "text")
    exch = corpus.ordered_text(conv, ["conv_id", "exchange"], "turn", "text", sep="\n") \
        .select("conv_id", F.lit("div_2").alias("kind"), F.col("exchange").alias("unit"), "text")
    whole = corpus.ordered_text(conv, ["conv_id"], "turn", "text", sep="\n") \
        .select("conv_id", F.lit("div_1").alias("kind"), F.lit(0).cast("bigint").alias("unit"), "text")
    units = staged(turns.unionByName(exch).unionByName(whole).withColumn("text", T.strip("text")), "context-units")
    sizes = units.select("conv_id", "kind", "unit", F.length("text").alias("len"))
    order = {k: i for i, k in enumerate(context.CONTEXT_ORDER)}
    asked = conv.select("conv_id", "turn", F.explode(F.array(*[
        F.struct(F.lit(order[k]).alias("prio"), F.lit(k).alias("kind"), u.alias("unit"))
        for k, u in (("paragraph", F.when(F.col("role") != "user", F.col("turn").cast("bigint")).otherwise(null)),
                     ("utterance", F.when(F.col("role") == "user", F.col("turn").cast("bigint")).otherwise(null)),
                     ("div_2", F.col("exchange")), ("div_1", F.lit(0).cast("bigint")))])).alias("c")).select("conv_id", "turn", "c.*")
    best = (asked.join(sizes, ["conv_id", "kind", "unit"]).where(F.col("len").isNotNull())
            .groupBy("conv_id", "turn").agg(F.min(F.struct("len", "prio", "kind", "unit")).alias("b"))
            .select("conv_id", "turn", F.col("b.kind").alias("kind"), F.col("b.unit").alias("unit")))
    lines = conv.select("conv_id", "turn", F.posexplode(F.split("text", "\n")).alias("line", "s"))
    keys = ["conv_id", "kind", "unit"]
    won = units.join(best.select(*keys).distinct(), keys).select(*keys, T.normalize_whitespace("text").alias("text"))
    won = staged(won, "context-texts")
    spans = first_occurrences(won, lines.join(best, ["conv_id", "turn"])
                              .select(*keys, "turn", "line", T.normalize_whitespace("s").alias("sentence")), keys)
    return (spans.join(won.select(*keys, F.md5("text").alias("context_md5")), keys)
            .select("conv_id", "turn", "line", F.col("kind").alias("min_kind"), "context_md5", "sentence_start_idx", "sentence_end_idx"))


register("smallest_context", f"""
WITH c AS (
  SELECT *, CAST(floor(turn / 2) AS BIGINT) AS exchange FROM conversations
), ex AS (
  SELECT conv_id, exchange, string_agg(text, {NL} ORDER BY turn) AS div_2 FROM c GROUP BY 1, 2
), wh AS (
  SELECT conv_id, string_agg(text, {NL} ORDER BY turn) AS div_1 FROM c GROUP BY 1
), lv AS (
  SELECT c.conv_id, c.turn, c.text,
         CASE WHEN c.role <> 'user' THEN c.text END AS paragraph,
         CASE WHEN c.role = 'user' THEN c.text END AS utterance,
         ex.div_2, wh.div_1
  FROM c JOIN ex ON c.conv_id = ex.conv_id AND c.exchange = ex.exchange
         JOIN wh ON c.conv_id = wh.conv_id
), cand AS (
  SELECT conv_id, turn, 0 AS prio, 'paragraph' AS kind, paragraph AS t FROM lv
  UNION ALL SELECT conv_id, turn, 1, 'utterance', utterance FROM lv
  UNION ALL SELECT conv_id, turn, 4, 'div_2', div_2 FROM lv
  UNION ALL SELECT conv_id, turn, 5, 'div_1', div_1 FROM lv
), best AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, turn
                               ORDER BY length({SQL_STRIP.format('t')}), prio) AS rn
  FROM cand WHERE t IS NOT NULL
), fin AS (
  SELECT conv_id, turn, kind AS min_kind, {SQL_NORM.format('t')} AS min_context FROM best WHERE rn = 1
), l AS (
  SELECT conv_id, turn, unnest(range(0, len(string_split(text, {NL})))) AS line, unnest(string_split(text, {NL})) AS s FROM c
), n AS (
  SELECT l.*, {SQL_NORM.format('s')} AS sent FROM l
)
SELECT n.conv_id, n.turn, CAST(n.line AS INTEGER) AS line, min_kind, md5(min_context) AS context_md5,
       CAST(instr(min_context, sent) - 1 AS INTEGER) AS sentence_start_idx,
       CAST(instr(min_context, sent) - 1 + length(sent) AS INTEGER) AS sentence_end_idx
FROM n JOIN fin ON n.conv_id = fin.conv_id AND n.turn = fin.turn
""")(smallest_context)


# Node numbering for the conversation tree: an array holds fewer than 2^31
# lines, so no turn outgrows its numbers, and every int turn fits a bigint.
B = 1 << 31


def _conv_nodes(conv):
    """Node table of the conversation tree: candidates (turns, exchanges,
    conversation) and sentence targets (lines). A line closes at its own
    number, a candidate at the last number of its range."""
    e = F.floor(F.col("turn") / 2).cast("bigint")
    exch_pre = F.lit(2) + e * (3 * B)
    turn_pre = exch_pre + 1 + (F.col("turn") - 2 * e) * B
    turns = conv.select(F.col("conv_id").alias("doc_id"), "turn", "role", "text",
                        exch_pre.alias("exch_pre"), turn_pre.alias("turn_pre"))
    cands = (turns.select("doc_id", F.col("turn_pre").alias("pre"), (F.col("turn_pre") + B - 1).alias("post"),
                          F.when(F.col("role") == "user", "u").otherwise("p").alias("kind"))
             .unionByName(turns.select("doc_id", F.col("exch_pre").alias("pre"), (F.col("exch_pre") + 3 * B - 1).alias("post"),
                                       F.lit("div_2").alias("kind")).distinct())
             .unionByName(turns.select("doc_id", F.lit(1).cast("bigint").alias("pre"), F.lit((1 << 63) - 1).alias("post"),
                                       F.lit("div_1").alias("kind")).distinct()))
    lines = turns.select("doc_id", "turn", "exch_pre", "turn_pre",
                         F.posexplode(F.split(F.col("text"), "\n")).alias("line", "s"))
    targets = lines.select("doc_id", "turn", "line", (F.col("turn_pre") + 1 + F.col("line")).alias("pre"),
                           (F.col("turn_pre") + 1 + F.col("line")).alias("post"))
    return cands, targets


def nearest_ancestor(spark, sf_dir):
    """Nearest enclosing p / u / div levels of every sentence (line)."""
    cands, targets = _conv_nodes(read(spark, sf_dir, "conversations"))
    kinds = ["p", "u", "div_4", "div_3", "div_2", "div_1"]
    near = context.nearest_ancestors(targets, cands, kinds)
    return (targets.select("doc_id", "pre", "turn", "line").join(near, ["doc_id", "pre"])
            .select(F.col("doc_id").alias("conv_id"), "turn", "line",
                    *[F.col(k).alias(f"{k}_pre") for k in kinds]))


register("nearest_ancestor", f"""
WITH t AS (
  SELECT conv_id AS doc_id, turn, role, text,
         2 + CAST(floor(turn / 2) AS BIGINT) * {3 * B} AS exch_pre
  FROM conversations
), t2 AS (
  SELECT *, exch_pre + 1 + (turn - 2 * CAST(floor(turn / 2) AS BIGINT)) * {B} AS turn_pre FROM t
), nodes AS (
  SELECT doc_id, turn_pre AS pre, turn_pre + {B} AS hi, CASE WHEN role = 'user' THEN 'u' ELSE 'p' END AS kind FROM t2
  UNION ALL SELECT DISTINCT doc_id, exch_pre, exch_pre + {3 * B}, 'div_2' FROM t2
  UNION ALL SELECT DISTINCT doc_id, 1, 9223372036854775807, 'div_1' FROM t2
), lines AS (
  SELECT doc_id, turn, unnest(range(0, len(string_split(text, {NL})))) AS line, turn_pre FROM t2
), s AS (
  SELECT doc_id, turn, line, turn_pre + 1 + line AS pre FROM lines
)
SELECT s.doc_id AS conv_id, s.turn, CAST(s.line AS INTEGER) AS line,
       max(CASE WHEN n.kind = 'p' THEN n.pre END) AS p_pre,
       max(CASE WHEN n.kind = 'u' THEN n.pre END) AS u_pre,
       CAST(NULL AS BIGINT) AS div_4_pre, CAST(NULL AS BIGINT) AS div_3_pre,
       max(CASE WHEN n.kind = 'div_2' THEN n.pre END) AS div_2_pre,
       max(CASE WHEN n.kind = 'div_1' THEN n.pre END) AS div_1_pre
FROM s LEFT JOIN nodes n ON s.doc_id = n.doc_id AND n.pre < s.pre AND n.hi > s.pre
GROUP BY s.doc_id, s.turn, s.line
""")(nearest_ancestor)


def nth_fragment(spark, sf_dir):
    """Each turn asks for fragment ``exchange + 1`` of its conversation;
    fragments are level-1 divs (user turns), or all turns when a
    conversation has no user turn."""
    conv = read(spark, sf_dir, "conversations")
    divs = conv.select("conv_id", F.col("turn").alias("pre"),
                       F.when(F.col("role") == "user", "1").otherwise("2").alias("level"))
    frags = context.fragment_ordinals(divs, doc="conv_id")
    req = conv.select("conv_id", "turn", (F.floor(F.col("turn") / 2) + 1).cast("int").alias("fragment_n"))
    return (req.join(frags.select("conv_id", "fragment_n", F.col("pre").alias("fragment_turn")),
                     ["conv_id", "fragment_n"], "left"))


register("nth_fragment", """
WITH d AS (
  SELECT conv_id, turn AS pre, CASE WHEN role = 'user' THEN '1' ELSE '2' END AS level,
         max(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id) AS has_l1
  FROM conversations
), f AS (
  SELECT conv_id, pre, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY pre) AS INTEGER) AS fragment_n
  FROM d WHERE has_l1 = 0 OR level = '1'
)
SELECT c.conv_id, c.turn, CAST(floor(c.turn / 2) + 1 AS INTEGER) AS fragment_n, f.pre AS fragment_turn
FROM conversations c LEFT JOIN f ON c.conv_id = f.conv_id AND f.fragment_n = floor(c.turn / 2) + 1
""")(nth_fragment)


def sentence_lookup(spark, sf_dir):
    """Examples ask for every sentence of each turn by (segment id, sentence
    number), and for one more, which comes back as not found."""
    conv = read(spark, sf_dir, "conversations")
    seg = F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-fragment"),
                   two_digits("turn"))
    sentences = conv.select(seg.alias("text_segment_id"),
                            F.posexplode(F.split(F.col("text"), "\n")).alias("pre", "line"))
    sentences = sentences.select("text_segment_id", (F.col("pre") + 1).cast("string").alias("sentence_number"),
                                 "pre", T.normalize_whitespace("line").alias("sentence"))
    ex = conv.select("conv_id", "turn", seg.alias("text_segment_id"),
                     F.explode(F.sequence(F.lit(1), F.size(F.split("text", "\n")) + 1).cast("array<string>")).alias("sentence_number"))
    out = context.lookup_sentences(ex, sentences)
    return out.select("conv_id", "turn", "sentence_number", F.col("sentence").isNotNull().alias("found"),
                      F.md5("sentence").alias("sentence_md5"))


register("sentence_lookup", f"""
WITH seg AS (
  SELECT conv_id, turn, text, 'c' || CAST(conv_id AS VARCHAR) || '-fragment' || lpad(CAST(turn AS VARCHAR), greatest(2, length(CAST(turn AS VARCHAR)))::INTEGER, '0') AS sid
  FROM conversations
), sent AS (
  SELECT sid, unnest(range(0, len(string_split(text, {NL})))) AS pre, unnest(string_split(text, {NL})) AS line FROM seg
), firsts AS (
  SELECT sid, CAST(pre + 1 AS VARCHAR) AS sentence_number, arg_min({SQL_NORM.format('line')}, pre) AS sentence
  FROM sent GROUP BY 1, 2
), ex AS (
  SELECT conv_id, turn, sid, CAST(unnest(range(1, len(string_split(text, {NL})) + 2)) AS VARCHAR) AS sentence_number FROM seg
)
SELECT ex.conv_id, ex.turn, ex.sentence_number, f.sentence IS NOT NULL AS found, md5(f.sentence) AS sentence_md5
FROM ex LEFT JOIN firsts f ON ex.sid = f.sid AND ex.sentence_number = f.sentence_number
""")(sentence_lookup)


# ------------------------------------------------------------- offsets, arguments

def _verb_probe(conv):
    raw = T.whitespace_tokens("text")
    n = F.size(raw)
    key = F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    k = bucket(F.concat(F.lit("verb:"), key), n)
    delta = bucket(F.concat(F.lit("off:"), key), 5) - 2
    return conv.select(
        "conv_id", "turn", raw.alias("raw_sentence"),
        F.when(n > 0, F.lower(F.get(raw, k.cast("int")))).otherwise(F.lit("")).alias("verb"),
        F.when(n > 0, F.greatest(k + 1 + delta, F.lit(0))).otherwise(F.lit(1)).cast("int").alias("word_offset"))


def offset_repair(spark, sf_dir):
    """Verb offsets perturbed by -2..+2 and repaired against the tokens."""
    p = _verb_probe(read(spark, sf_dir, "conversations"))
    return p.select("conv_id", "turn", "verb", "word_offset",
                    arguments.repair_word_offset().alias("fixed_offset"))


_SQL_KEY = "CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR)"


def _sql_probe(i: str) -> tuple[str, str]:
    ok = f"({i} >= -n AND {i} < n)"
    val = f"lower(raw[CASE WHEN {i} < 0 THEN n + {i} ELSE {i} END + 1])"
    return ok, val


_ok1, _t1 = _sql_probe("(o - 1)")
_ok2, _t2 = _sql_probe("o")
_ok3, _t3 = _sql_probe("(o + 1)")
register("offset_repair", f"""
WITH r AS (
  SELECT conv_id, turn, {SQL_WS_TOKENS.format('text')} AS raw FROM conversations
), r2 AS (
  SELECT *, len(raw) AS n,
         {sql_bucket("'verb:' || " + _SQL_KEY, "len(raw)")} AS k,
         {sql_bucket("'off:' || " + _SQL_KEY, 5)} - 2 AS delta
  FROM r
), p AS (
  SELECT conv_id, turn, raw, n,
         CASE WHEN n > 0 THEN lower(raw[k + 1]) ELSE '' END AS verb,
         CAST(CASE WHEN n > 0 THEN greatest(k + 1 + delta, 0) ELSE 1 END AS INTEGER) AS o
  FROM r2
)
SELECT conv_id, turn, verb, o AS word_offset,
       CAST(CASE WHEN NOT {_ok1} THEN o WHEN {_t1} = verb THEN o
            WHEN NOT {_ok2} THEN o WHEN {_t2} = verb THEN o + 1
            WHEN NOT {_ok3} THEN o WHEN {_t3} = verb THEN o + 2
            WHEN coalesce(list_position(list_transform(raw, lambda t: lower(t)), verb), 0) = 0 THEN o
            ELSE list_position(list_transform(raw, lambda t: lower(t)), verb) END AS INTEGER) AS fixed_offset
FROM p
""")(offset_repair)


# Stand-in dependency labels drawn per token (root when the governor is 0).
DEP_LABELS = ("nsubj", "dobj", "case", "amod", "det", "advmod")
LEMMA_STRIP = r"[^\p{L}]"


def parses(conv):
    """Stand-in parse of every turn, in its row: one dependency per token with
    an md5-drawn governor (0 = root) and label."""
    toks = T.whitespace_tokens("text")
    sent = conv.select("conv_id", "turn", toks.alias("toks"),
                       F.transform(toks, lambda t: F.lower(F.regexp_replace(t, LEMMA_STRIP, ""))).alias("lem"))
    labels = F.array(*[F.lit(x) for x in DEP_LABELS])

    def dependency(tok, i):
        key = F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string"), (i + 1).cast("string"))
        g = bucket(F.concat(F.lit("gov:"), key), F.size("toks") + 1).cast("int")
        lab = F.element_at(labels, (bucket(F.concat(F.lit("dep:"), key), len(DEP_LABELS)) + 1).cast("int"))
        return F.struct(
            F.when(g == 0, F.lit("root")).otherwise(lab).alias("dep"), g.alias("governor"), (i + 1).cast("int").alias("dependent"),
            tok.alias("dependent_gloss"), F.get("lem", i).alias("dependent_lemma"),
            F.when(g == 0, F.lit("ROOT")).otherwise(F.get("toks", g - 1)).alias("governor_gloss"),
            F.when(g == 0, F.lit("root")).otherwise(F.get("lem", g - 1)).alias("governor_lemma"))
    return sent.select("conv_id", "turn", F.transform("toks", dependency).alias("deps"))


def dep_arguments(spark, sf_dir):
    """Subject/object and their lemmas for every token taken as the verb."""
    return arguments.all_arguments(parses(read_spread(spark, sf_dir, "conversations")), ["conv_id", "turn"])


_labels_sql = ", ".join(f"'{x}'" for x in DEP_LABELS)
_KEY3 = "CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR) || ':' || CAST(i AS VARCHAR)"
register("dep_arguments", f"""
WITH s AS (
  SELECT conv_id, turn, {SQL_WS_TOKENS.format('text')} AS toks FROM conversations
), s2 AS (
  SELECT *, list_transform(toks, lambda t: lower(regexp_replace(t, '{LEMMA_STRIP}', '', 'g'))) AS lem FROM s
), r AS (
  SELECT conv_id, turn, toks, lem, unnest(range(1, len(toks) + 1)) AS i FROM s2
), d0 AS (
  SELECT conv_id, turn, toks, lem, i,
         CAST({sql_bucket("'gov:' || " + _KEY3, "(len(toks) + 1)")} AS INTEGER) AS g,
         [{_labels_sql}][{sql_bucket("'dep:' || " + _KEY3, len(DEP_LABELS))} + 1] AS lab
  FROM r
), deps AS (
  SELECT conv_id, turn, i AS dependent, g AS governor,
         CASE WHEN g = 0 THEN 'root' ELSE lab END AS dep,
         toks[i] AS dependent_gloss, lem[i] AS dependent_lemma,
         CASE WHEN g = 0 THEN 'ROOT' ELSE toks[g] END AS governor_gloss,
         CASE WHEN g = 0 THEN 'root' ELSE lem[g] END AS governor_lemma
  FROM d0
), gov AS (
  SELECT conv_id, turn, governor AS w,
         arg_max(CASE WHEN dep = 'nsubj' THEN dependent_gloss END, CASE WHEN dep = 'nsubj' THEN dependent END) AS sg,
         arg_max(CASE WHEN dep = 'nsubj' THEN dependent_lemma END, CASE WHEN dep = 'nsubj' THEN dependent END) AS sl,
         arg_max(CASE WHEN dep = 'dobj' THEN dependent_gloss END, CASE WHEN dep = 'dobj' THEN dependent END) AS og,
         arg_max(CASE WHEN dep = 'dobj' THEN dependent_lemma END, CASE WHEN dep = 'dobj' THEN dependent END) AS ol
  FROM deps WHERE governor > 0 GROUP BY 1, 2, 3
), cs AS (
  SELECT conv_id, turn, dependent AS w, arg_min(governor_gloss, dependent) AS cg, arg_min(governor_lemma, dependent) AS cl
  FROM deps WHERE dep = 'case' GROUP BY 1, 2, 3
)
SELECT v.conv_id, v.turn, CAST(v.dependent AS INTEGER) AS word_offset,
       CASE WHEN g.w IS NOT NULL THEN coalesce(lower(g.sg), '') ELSE '' END AS subject,
       CASE WHEN g.w IS NOT NULL THEN coalesce(lower(g.og), '') ELSE coalesce(lower(c.cg), '') END AS object,
       CASE WHEN g.w IS NOT NULL THEN coalesce(lower(g.sl), '') ELSE '' END AS subject_lemma,
       CASE WHEN g.w IS NOT NULL THEN coalesce(lower(g.ol), '') ELSE coalesce(lower(c.cl), '') END AS object_lemma
FROM deps v
LEFT JOIN gov g ON v.conv_id = g.conv_id AND v.turn = g.turn AND v.dependent = g.w
LEFT JOIN cs c ON v.conv_id = c.conv_id AND v.turn = c.turn AND v.dependent = c.w
""")(dep_arguments)
