"""SQL building blocks for the independent check of the queries."""

from __future__ import annotations

from inkgauge.functions import edits, patterns
from inkgauge.functions.stopwords import ENGLISH_STOP_WORDS
from inkgauge.operators.splits import SEED
from inkgauge.plans.views import COEFFICIENTS
from inkgauge.sources import generate


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def lits(texts) -> str:
    return "[" + ", ".join(lit(t) for t in texts) + "]"


def drop(x: str, pattern: str, by: str = "") -> str:
    return f"regexp_replace({x}, {lit(pattern)}, {lit(by)}, 'g')"


def collapse(x: str) -> str:
    return f"trim({drop(x, patterns.SPACE_RUN, ' ')})"


def clean(x: str) -> str:
    x = f"coalesce({x}, '')"
    for pattern in (patterns.HTML_TAG, patterns.URL, patterns.HANDLE, patterns.HASHTAG):
        x = drop(x, pattern)
    return collapse(x)


def sentences(x: str) -> str:
    return (
        f"list_filter(list_transform(string_split_regex({collapse(x)}, '[.!?]+'), "
        "lambda s: trim(s)), lambda s: s <> '')"
    )


def lengths(sents: str) -> str:
    return f"list_transform({sents}, lambda s: CAST(len(string_split(s, ' ')) AS INTEGER))"


def burstiness(lens: str) -> str:
    return f"CASE WHEN len({lens}) < 2 THEN 0.0 ELSE list_aggregate({lens}, 'stddev_pop') END"


def hashed(slot: str, key: str) -> str:
    return f"('0x' || substr(md5('{SEED}|{slot}|' || CAST({key} AS VARCHAR)), 1, 8))::BIGINT"


def pick(options, slot: str, key: str) -> str:
    return f"{lits(options)}[({hashed(slot, key)} % {len(options)}) + 1]"


def tokens(x: str) -> str:
    return f"regexp_extract_all(lower({x}), {lit(patterns.TERM_TOKEN)})"


def kept(x: str) -> str:
    return f"list_filter({tokens(x)}, lambda t: NOT list_contains({lits(ENGLISH_STOP_WORDS)}, t))"


def ngrams(k: str) -> str:
    return (
        f"list_concat({k}, list_transform(range(1, greatest(len({k}), 1)), "
        f"lambda i: {k}[i] || ' ' || {k}[i + 1]))"
    )


def prob(name: str) -> str:
    b0, b1, b2 = COEFFICIENTS[name]
    return f"round(1.0 / (1.0 + exp(-({b0} + ({b1}) * perp_scaled + ({b2}) * burst_scaled))), 6)"


def _perplexity_sql(row: str) -> str:
    return f"""SELECT doc_id,
  exp(least(sum(n * -ln((cw + 1)::DOUBLE / (tokens + v))) / sum(n), 100)) AS unigram_perplexity,
  exp(least(sum(n * -ln(0.7 * coalesce(cuw::DOUBLE / nullif(cu, 0), 0) + (1.0 - 0.7) * (cw + 1)::DOUBLE / (tokens + v))) / sum(n), 100)) AS perplexity
FROM {row} GROUP BY doc_id"""


def perplexity_of(corpus: str, name: str) -> dict[str, tuple[str, tuple[str, ...]]]:
    """CTEs that end in `<name>` (doc_id, unigram_perplexity, perplexity)."""
    tok, uni, bi, pre = (f"{name}_{p}" for p in ("tok", "uni", "bi", "pre"))
    pair, size, row = (f"{name}_{p}" for p in ("pair", "size", "row"))
    return {
        tok: (
            f"SELECT doc_id, {hashed('fold', 'doc_id')} % 5 AS fold, regexp_extract_all(lower(text), {lit(patterns.LM_TOKEN)}) AS t FROM {corpus}",
            (corpus,),
        ),
        uni: (f"SELECT fold, term, count(*) AS n FROM (SELECT fold, unnest(t) AS term FROM {tok}) GROUP BY ALL", (tok,)),
        pair: (
            f"SELECT doc_id, fold, t[i] AS prev, t[i + 1] AS term FROM (SELECT *, unnest(range(1, len(t))) AS i FROM {tok} WHERE len(t) > 1)",
            (tok,),
        ),
        bi: (f"SELECT fold, prev, term, count(*) AS n FROM {pair} GROUP BY ALL", (pair,)),
        pre: (f"SELECT fold, prev, sum(n) AS n FROM {bi} GROUP BY ALL", (bi,)),
        size: (
            f"SELECT f.fold, (SELECT sum(n) FROM {uni} u WHERE u.fold <> f.fold) AS n, "
            f"(SELECT count(DISTINCT term) FROM {uni}) AS v FROM (SELECT DISTINCT fold FROM {tok}) f",
            (uni, tok),
        ),
        row: (
            f"""SELECT p.doc_id, p.n,
  coalesce(ta.n, 0) - coalesce(tf.n, 0) AS cw, coalesce(pa.n, 0) - coalesce(pf.n, 0) AS cu,
  coalesce(ba.n, 0) - coalesce(bf.n, 0) AS cuw, z.n AS tokens, z.v
FROM (SELECT doc_id, fold, prev, term, count(*) AS n FROM {pair} GROUP BY ALL) p
JOIN {size} z ON z.fold = p.fold
LEFT JOIN (SELECT term, sum(n) AS n FROM {uni} GROUP BY ALL) ta ON ta.term = p.term
LEFT JOIN {uni} tf ON tf.term = p.term AND tf.fold = p.fold
LEFT JOIN (SELECT prev, sum(n) AS n FROM {pre} GROUP BY ALL) pa ON pa.prev = p.prev
LEFT JOIN {pre} pf ON pf.prev = p.prev AND pf.fold = p.fold
LEFT JOIN (SELECT prev, term, sum(n) AS n FROM {bi} GROUP BY ALL) ba ON ba.prev = p.prev AND ba.term = p.term
LEFT JOIN {bi} bf ON bf.prev = p.prev AND bf.term = p.term AND bf.fold = p.fold""",
            (pair, size, uni, pre, bi),
        ),
        name: (_perplexity_sql(row), (row,)),
    }


def new_perplexity_of(texts: str, name: str, corpus: str) -> dict[str, tuple[str, tuple[str, ...]]]:
    """CTEs that end in `<name>`: texts from outside a corpus under all counts of that corpus."""
    tok, pair, row = (f"{name}_{p}" for p in ("tok", "pair", "row"))
    uni, bi, pre = (f"{corpus}_{p}" for p in ("uni", "bi", "pre"))
    return {
        tok: (f"SELECT doc_id, regexp_extract_all(lower(text), {lit(patterns.LM_TOKEN)}) AS t FROM {texts}", (texts,)),
        pair: (
            "SELECT doc_id, prev, term, count(*) AS n FROM (SELECT doc_id, t[i] AS prev, t[i + 1] AS term "
            f"FROM (SELECT *, unnest(range(1, len(t))) AS i FROM {tok} WHERE len(t) > 1)) GROUP BY ALL",
            (tok,),
        ),
        row: (
            f"""SELECT p.doc_id, p.n, coalesce(u.n, 0) AS cw, coalesce(a.n, 0) AS cu, coalesce(b.n, 0) AS cuw, z.n AS tokens, z.v
FROM {pair} p CROSS JOIN (SELECT sum(n) AS n, count(DISTINCT term) AS v FROM {uni}) z
LEFT JOIN (SELECT term, sum(n) AS n FROM {uni} GROUP BY ALL) u ON u.term = p.term
LEFT JOIN (SELECT prev, sum(n) AS n FROM {pre} GROUP BY ALL) a ON a.prev = p.prev
LEFT JOIN (SELECT prev, term, sum(n) AS n FROM {bi} GROUP BY ALL) b ON b.prev = p.prev AND b.term = p.term""",
            (pair, uni, pre, bi),
        ),
        name: (_perplexity_sql(row), (row,)),
    }


def _filled(key: str) -> str:
    """Expression of a filled template over a `chosen` template text `t`."""
    x = "t"
    used = {slot for _, t in generate.TEMPLATES for slot in generate._SLOT.findall(t)}
    for slot in sorted(used & generate.FILLERS.keys()):
        x = f"regexp_replace({x}, '\\{{{slot}\\}}', {pick(generate.FILLERS[slot], slot, key)})"
    return x


def humanised(x: str, key: str) -> str:
    """Name of the CTE chain is in `CTES`; this is the rule part."""
    for pattern, by in edits.PHRASE_RULES:
        x = f"regexp_replace({x}, {lit(pattern)}, {lit(by)}, 'g')"
    return x


_marked = f"regexp_replace(ruled, '([.!?])' || {lit(patterns.SPACE_RUN)}, '\\1' || chr(1), 'g')"
_edge = f"'^' || {lit(patterns.SPACE_RUN)} || '|' || {lit(patterns.SPACE_RUN)} || '$'"


def contracted(x: str) -> str:
    for full, short in edits.CONTRACTIONS:
        x = f"replace({x}, {lit(full)}, {lit(short)})"
    return x


def edit_ctes(corpus: str, name: str) -> dict[str, tuple[str, tuple[str, ...]]]:
    ruled, split, opened, aside = (f"{name}_{p}" for p in ("ruled", "split", "opened", "aside"))
    return {
        ruled: (f"SELECT *, {humanised('text', 'doc_id')} AS ruled FROM {corpus}", (corpus,)),
        split: (
            f"SELECT *, list_filter(list_transform(string_split({_marked}, chr(1)), "
            f"lambda s: regexp_replace(s, {_edge}, '', 'g')), lambda s: s <> '') AS s FROM {ruled}",
            (ruled,),
        ),
        opened: (
            f"SELECT *, list_concat([{pick(edits.OPENINGS, 'opening', 'doc_id')} || lower(substr(s[1], 1, 1)) || substr(s[1], 2)], s[2:]) AS o FROM {split}",
            (split,),
        ),
        aside: (
            f"SELECT *, CASE WHEN len(o) > 1 THEN list_concat(o[1:1], [{pick(edits.ASIDES, 'aside', 'doc_id')}], o[2:]) ELSE o END AS a FROM {opened}",
            (opened,),
        ),
        name: (
            f"SELECT *, CASE WHEN len(s) = 0 THEN text ELSE {contracted('array_to_string(a, chr(32)) || ' + pick(edits.HEDGES, 'hedge', 'doc_id'))} END AS edited FROM {aside}",
            (aside,),
        ),
    }


def _stats_over(name: str, corpus: str) -> dict[str, tuple[str, tuple[str, ...]]]:
    return {
        f"{name}_len": (f"SELECT *, {lengths(sentences('text'))} AS lens FROM {corpus}", (corpus,)),
        f"{name}_style": (f"SELECT *, {burstiness('lens')} AS burstiness FROM {name}_len", (f"{name}_len",)),
    }


_BASE = "SELECT d.doc_id, d.text, l.quality AS label, d.source, d.lang FROM documents d JOIN labels l USING (doc_id)"

CTES: dict[str, tuple[str, tuple[str, ...]]] = {
    "base": (_BASE, ()),
    "cleaned": (f"SELECT doc_id, {clean('text')} AS text, label, source, lang FROM base", ("base",)),
    "clean": (
        "SELECT doc_id, text, label, source, lang FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn "
        "FROM cleaned WHERE length(text) > 20) WHERE rn = 1",
        ("cleaned",),
    ),
    **perplexity_of("clean", "ppl"),
    **_stats_over("clean", "clean"),
    "feats": (
        "SELECT c.*, p.unigram_perplexity, p.perplexity, ln(1 + coalesce(p.perplexity, 0)) / 5 AS perp_scaled, burstiness / 5 AS burst_scaled "
        "FROM clean_style c LEFT JOIN ppl p USING (doc_id)",
        ("clean_style", "ppl"),
    ),
    "probs": (f"SELECT *, {prob('a')} AS prob_a, {prob('b')} AS prob_b FROM feats", ("feats",)),
    "pred": (
        "SELECT *, CASE WHEN prob_a >= 0.5 THEN 1 ELSE 0 END AS pred_a, CASE WHEN prob_b >= 0.5 THEN 1 ELSE 0 END AS pred_b FROM probs",
        ("probs",),
    ),
    "scored": ("SELECT *, prob_a AS prob, pred_a AS pred FROM pred", ("pred",)),
    "split": (
        "SELECT *, CASE WHEN 100 * r < 70 * n THEN 'train' WHEN 100 * r < 85 * n THEN 'val' ELSE 'test' END AS split FROM ("
        f"SELECT *, row_number() OVER (PARTITION BY label ORDER BY {hashed('split', 'doc_id')}, doc_id) - 1 AS r, "
        "count(*) OVER (PARTITION BY label) AS n FROM clean)",
        ("clean",),
    ),
    "tested": ("SELECT s.*, t.split FROM scored s JOIN split t USING (doc_id) WHERE t.split = 'test'", ("scored", "split")),
    "long": (
        "SELECT doc_id, source, label, 'baseline' AS model, prob_a AS prob, pred_a AS pred FROM pred "
        "UNION ALL SELECT doc_id, source, label, 'hybrid', prob_b, pred_b FROM pred",
        ("pred",),
    ),
    "drawn": (
        f"SELECT doc_id, {hashed('template', 'doc_id')} % {len(generate.TEMPLATES)} AS slot FROM documents",
        (),
    ),
    "chosen": (
        f"SELECT doc_id, {lits([t for _, t in generate.TEMPLATES])}[slot + 1] AS t, "
        f"[{', '.join(str(lab) for lab, _ in generate.TEMPLATES)}][slot + 1] AS label FROM drawn",
        ("drawn",),
    ),
    "filled": (f"SELECT doc_id, {_filled('doc_id')} AS text, label FROM chosen", ("chosen",)),
    "made": (
        "SELECT doc_id, text, label, 'custom_synthetic' AS source FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn FROM filled) WHERE rn = 1",
        ("filled",),
    ),
    "united": (
        "SELECT doc_id, 0::BIGINT AS turn, text, label, 'documents' AS source, 0 AS source_rank FROM base "
        "UNION ALL SELECT item_id, 0, text, 0, 'benchmark', 1 FROM benchmark "
        "UNION ALL SELECT conv_id, turn, text, CASE WHEN lower(CASE WHEN role = 'assistant' THEN 'ai' ELSE role END) IN ('bot', '1', 'ai', 'machine') THEN 1 ELSE 0 END, 'conversations', 2 FROM conversations",
        ("base",),
    ),
    "dataset_raw": (
        "SELECT doc_id, turn, text, label, source, source_rank FROM united UNION ALL SELECT doc_id, 0, text, label, source, 3 FROM made",
        ("united", "made"),
    ),
    "dataset": (
        "SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY source_rank, doc_id, turn) AS rn "
        f"FROM (SELECT * REPLACE ({clean('text')} AS text) FROM dataset_raw) WHERE length(text) > 20) WHERE rn = 1",
        ("dataset_raw",),
    ),
    "terms": (f"SELECT doc_id, {kept('text')} AS k FROM clean", ("clean",)),
    "grams": (f"SELECT doc_id, {ngrams('k')} AS g FROM terms", ("terms",)),
    "tf": ("SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(g) AS term FROM grams) GROUP BY ALL", ("grams",)),
    "stats": ("SELECT term, sum(tf)::BIGINT AS total, count(*) AS df FROM tf GROUP BY term", ("tf",)),
    "train_stats": (
        "SELECT term, sum(tf)::BIGINT AS total FROM tf JOIN split USING (doc_id) WHERE split = 'train' GROUP BY term",
        ("tf", "split"),
    ),
    "dataset_split": (
        "SELECT *, CASE WHEN 100 * r < 70 * n THEN 'train' WHEN 100 * r < 85 * n THEN 'val' ELSE 'test' END AS split FROM ("
        f"SELECT *, row_number() OVER (PARTITION BY label ORDER BY {hashed('split', 'row_id')}, row_id) - 1 AS r, "
        "count(*) OVER (PARTITION BY label) AS n FROM (SELECT *, source_rank || ':' || doc_id || ':' || turn AS row_id FROM dataset))",
        ("dataset",),
    ),
    "vocab": ("SELECT *, ln((1.0 + (SELECT count(*) FROM clean)) / (1.0 + df)) + 1 AS idf FROM (SELECT * FROM stats ORDER BY total DESC, term LIMIT 10000)", ("stats", "clean")),
    "weighted": ("SELECT t.doc_id, t.term, t.tf * v.idf AS w FROM tf t JOIN vocab v USING (term)", ("tf", "vocab")),
    "weights": ("SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS weight FROM weighted", ("weighted",)),
    # all documents, labelled or not
    "every_cleaned": (f"SELECT doc_id, {clean('text')} AS text, source, lang FROM documents", ()),
    "every": (
        "SELECT doc_id, text, source, lang FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn "
        "FROM every_cleaned WHERE length(text) > 20) WHERE rn = 1",
        ("every_cleaned",),
    ),
    **perplexity_of("every", "eppl"),
    **_stats_over("every", "every"),
    "every_feats": (
        "SELECT c.*, p.perplexity, ln(1 + coalesce(p.perplexity, 0)) / 5 AS perp_scaled, burstiness / 5 AS burst_scaled "
        "FROM every_style c LEFT JOIN eppl p USING (doc_id)",
        ("every_style", "eppl"),
    ),
    "every_tf": (
        "SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(g) AS term FROM "
        f"(SELECT doc_id, {ngrams('k')} AS g FROM (SELECT doc_id, {kept('text')} AS k FROM every))) GROUP BY ALL",
        ("every",),
    ),
    "every_stats": (
        "SELECT term, total, df, ln((1.0 + (SELECT count(*) FROM every)) / (1.0 + df)) + 1 AS idf "
        "FROM (SELECT term, sum(tf)::BIGINT AS total, count(*) AS df FROM every_tf GROUP BY term)",
        ("every_tf", "every"),
    ),
    "every_vocab": ("SELECT * FROM every_stats ORDER BY total DESC, term LIMIT 10000", ("every_stats",)),
    "every_weights": (
        "SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS weight "
        "FROM (SELECT t.doc_id, t.term, t.tf * v.idf AS w FROM every_tf t JOIN every_vocab v USING (term))",
        ("every_tf", "every_vocab"),
    ),
    "ai": ("SELECT * FROM pred WHERE label = 1", ("pred",)),
    **edit_ctes("ai", "edit"),
    "challenge_text": (
        "SELECT doc_id, label, source || '_edited' AS source, text AS original_text, edited AS text, perplexity, perp_scaled FROM edit",
        ("edit",),
    ),
    **_stats_over("challenge", "challenge_text"),
    "challenge_feats": ("SELECT *, burstiness / 5 AS burst_scaled FROM challenge_style", ("challenge_style",)),
    "challenge_probs": (f"SELECT *, {prob('a')} AS prob_a, {prob('b')} AS prob_b FROM challenge_feats", ("challenge_feats",)),
    "challenge": (
        "SELECT *, CASE WHEN prob_a >= 0.5 THEN 1 ELSE 0 END AS pred_a, CASE WHEN prob_b >= 0.5 THEN 1 ELSE 0 END AS pred_b FROM challenge_probs",
        ("challenge_probs",),
    ),
    "challenge_long": (
        "SELECT doc_id, label, 'baseline' AS model, prob_a AS prob, pred_a AS pred FROM challenge "
        "UNION ALL SELECT doc_id, label, 'hybrid', prob_b, pred_b FROM challenge",
        ("challenge",),
    ),
    # uncleaned documents, as a batch is scored
    **new_perplexity_of("documents", "rawppl", "ppl"),
    **_stats_over("raw", "documents"),
    "raw_feats": (
        "SELECT c.*, p.perplexity, ln(1 + coalesce(p.perplexity, 0)) / 5 AS perp_scaled, burstiness / 5 AS burst_scaled "
        "FROM raw_style c LEFT JOIN rawppl p USING (doc_id)",
        ("raw_style", "rawppl"),
    ),
    "raw_scored": (f"SELECT *, {prob('a')} AS prob FROM raw_feats", ("raw_feats",)),
}


def with_views(select: str, *names: str) -> str:
    """`select` behind the CTEs it names and all that those need, in order."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order or name not in CTES:
            return
        for needed in CTES[name][1]:
            visit(needed)
        order.append(name)

    for name in names:
        visit(name)
    if not order:
        return select
    ctes = ",\n".join(f"{name} AS MATERIALIZED ({CTES[name][0]})" for name in order)
    return f"WITH {ctes}\n{select}"


CONFIDENCE = "abs(prob - 0.5) * 200"
GRAY_ZONE = (
    f"CASE WHEN prob >= 0.60 AND prob <= 0.85 AND {CONFIDENCE} <= 45 THEN 'edited_ai' "
    "WHEN prob > 0.85 THEN 'strong_ai' WHEN prob < 0.40 THEN 'likely_human' ELSE 'uncertain' END"
)


def metric_columns(by: str = "") -> str:
    return f"""count(*) AS samples,
  round(sum((pred = label)::INT)::DOUBLE / count(*), 6) AS accuracy,
  round(coalesce(sum((pred = 1 AND label = 1)::INT)::DOUBLE / nullif(sum((pred = 1)::INT), 0), 0), 6) AS precision,
  round(coalesce(sum((pred = 1 AND label = 1)::INT)::DOUBLE / nullif(sum((label = 1)::INT), 0), 0), 6) AS recall,
  round(coalesce(2.0 * sum((pred = 1 AND label = 1)::INT) / nullif(sum((pred = 1)::INT) + sum((label = 1)::INT), 0), 0), 6) AS f1"""


def auc(rows: str, by: str = "") -> str:
    """Pairwise count of (positive, negative) wins with ties half, per `by`."""
    key = f"{by}, " if by else ""
    on = f"AND a.{by} = b.{by}" if by else ""
    group = f"GROUP BY a.{by}" if by else ""
    return (
        f"SELECT {'a.' + by + ', ' if by else ''}round(sum(CASE WHEN a.prob > b.prob THEN 1.0 WHEN a.prob = b.prob THEN 0.5 ELSE 0.0 END) / nullif(count(*), 0), 6) AS roc_auc "
        f"FROM (SELECT {key}prob FROM {rows} WHERE label = 1) a JOIN (SELECT {key}prob FROM {rows} WHERE label = 0) b ON true {on} {group}"
    )


def metrics(rows: str, by: str = "") -> str:
    if not by:
        return f"SELECT m.*, (SELECT roc_auc FROM ({auc(rows)})) AS roc_auc FROM (SELECT {metric_columns()} FROM {rows}) m"
    return (
        f"SELECT m.*, a.roc_auc FROM (SELECT {by}, {metric_columns()} FROM {rows} GROUP BY {by}) m "
        f"LEFT JOIN ({auc(rows, by)}) a USING ({by})"
    )
