"""The registered queries of the corpus operators: each applies one operator to its whole table."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import decontaminate, exact_dedup, fill_middle, html_extract, importance_sampling, line_dedup, minhash_dedup, ngram_lm, quality, secrets, sentencepiece_fst, suffix_dedup, toxicity
from millrace.llm.common import table

#: Folder of public tokenizer files and the model that the query uses; both can be set.
TOKENIZERS = os.environ.get("MILLRACE_TOKENIZERS", "/opt/tokenizers")
PIECES = "piece_bpe_32k.model"
#: Words of the longest n-grams of op10.
ORDER = 3
#: Score from which op11 calls a document good.
QUALITY_FROM = 0.3


def tokenizer_bytes(name: str = PIECES, folder: str = TOKENIZERS) -> bytes:
    with open(os.path.join(folder, name), "rb") as f:
        return f.read()


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_markov of every document."""
    found = secrets.scan_secrets(table(spark, sf_dir, "documents"), min_chars=16)  # bound by the curve in the README
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", spans.alias("spans"), "n_markov")


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, text, n_chars, n_lines, n_shared of every page."""
    return html_extract.extract_main_text(table(spark, sf_dir, "pages"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document: repeats of 100 bytes."""
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document and leaked test item."""
    return decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The encoding of every document and whether it decodes to the text."""
    return sentencepiece_fst.encode_documents(table(spark, sf_dir, "documents"), tokenizer_bytes())


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text without repeated lines, n_lines, n_removed of every document."""
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every document."""
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op8_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document: three words, 85 percent."""
    return minhash_dedup.near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, expected_severity, p_toxic, rejected of every document, by a model fitted on labels."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_toxicity(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op10_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every document under a model of those with crc32(doc_id) mod 10 other than 0 (a null id: held out)."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "text", (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 10 == 0).alias("held_out"))
    model = ngram_lm.train(docs.filter("not held_out"), order=ORDER)
    return (ngram_lm.score_texts(docs, model, keep=("doc_id", "held_out"))
            .select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"),
                    "base_score", "score", "perplexity"))


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document: labels of crc32(doc_id) mod 5 = 0 (null id: 0) are never learned from."""
    docs, fold = table(spark, sf_dir, "documents"), F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5
    model = quality.train(docs, table(spark, sf_dir, "labels"), may_learn=fold != 0)
    return quality.score_quality(docs, model).select(
        "doc_id", (fold == 0).alias("held_out"), "score", (F.col("score") >= QUALITY_FROM).cast("int").alias("predicted"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every document, drawn towards the benchmark's texts."""
    drawn = importance_sampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256 of every document, cut by code points."""
    cut = fill_middle.transform(table(spark, sf_dir, "documents"))
    back = fill_middle.restored(F.col("output"), F.col("form"))
    return cut.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", back["restored_sha256"].alias("restored_sha256"))


QUERIES = {
    "op1_secrets": op1_secrets,
    "op2_html_text": op2_html_text,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_decontaminate": op4_decontaminate,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_line_dedup": op6_line_dedup,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_minhash_dedup": op8_minhash_dedup,
    "op9_toxicity": op9_toxicity,
    "op10_language_model": op10_language_model,
    "op11_quality": op11_quality,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_fill_middle": op13_fill_middle,
}

ORACLES = {
    # Blank lines stay; lines under 20 characters repeat only when equal.  One edit touches one place, so the first or the last
    # half of the shorter line is common: a sound filter.
    "op6_line_dedup": """
        with t as (select doc_id, coalesce(text, '') as text from documents),
        e as (select doc_id, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as pos from t),
        f as (select line, min(row(doc_id, pos)) as place, length(line) as n from e where regexp_matches(line, '[^\\x20\\x09-\\x0D]') group by line),
        g as (select distinct b.line from f a join f b on a.n >= 20 and b.n >= 20 and b.n between a.n - 1 and a.n + 1 and a.place < b.place
              and (left(a.line, cast(floor(least(a.n, b.n) / 2) as int)) = left(b.line, cast(floor(least(a.n, b.n) / 2) as int))
                or right(a.line, cast(floor(least(a.n, b.n) / 2) as int)) = right(b.line, cast(floor(least(a.n, b.n) / 2) as int)))
              where levenshtein(a.line, b.line) <= 1),
        k as (select e.*, f.line is null or (f.place = row(e.doc_id, e.pos) and g.line is null) as stays
              from e left join f on e.line = f.line left join g on e.line = g.line)
        select doc_id, coalesce(string_agg(line, chr(10) order by pos) filter (stays), '') as text,
               count(*) as n_lines, count(*) filter (not stays) as n_removed from k group by doc_id""",
    "op7_exact_dedup": """
        with h as (select doc_id, sha256(coalesce(text, '')) as text_sha256 from documents)
        select doc_id, max(doc_id) over g as keep_id, count(*) over g as group_size,
               doc_id = max(doc_id) over g as kept, text_sha256
        from h window g as (partition by text_sha256)""",
    "op8_minhash_dedup": """
        with recursive w as (
          select doc_id, list_filter(regexp_split_to_array(
                   translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                   '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as ws from documents),
        s as (select doc_id, case when len(ws) = 0 then [] when len(ws) < 3 then [array_to_string(ws, ' ')]
                else list_distinct([array_to_string(ws[i:i+2], ' ') for i in range(1, len(ws) - 1)]) end as sh from w),
        n as (select doc_id, cast(len(sh) as bigint) as n_shingles from s),
        e as (select doc_id, unnest(sh) as g from s),
        c as (select a.doc_id as x, b.doc_id as y, count(*) as k from e a join e b on a.g = b.g and a.doc_id <> b.doc_id group by all),
        l as (select x, y from c join n p on p.doc_id = x join n q on q.doc_id = y
              where 100 * k >= 85 * (p.n_shingles + q.n_shingles - k)),
        r as (select doc_id, doc_id as reach from documents union select l.y, r.reach from r join l on l.x = r.doc_id),
        m as (select doc_id, min(reach) as component_id from r group by doc_id)
        select doc_id, n_shingles, component_id, doc_id = component_id as kept from n join m using (doc_id)""",
    # crc32 by its table of 256, which is made by its rule.
    "op12_importance_resampling": """
        with k as (select list(c order by i) as tab from (select i, list_reduce(list_prepend(i, range(8)),
                     lambda c, n: case when c % 2 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as c from range(256) r(i))),
        src as (select 0 as is_target, doc_id, coalesce(text, '') as text from documents union all select 1, null, coalesce(text, '') from benchmark),
        w as (select is_target, doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                     '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as ws from src),
        e as (select is_target, doc_id, unnest(ws) as word from w),
        b as (select word, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(octet_length(encode(word))),
                     lambda i: cast('0x' || hex(encode(word))[2 * i + 1:2 * i + 2] as bigint))),
                     lambda c, x: xor(c >> 8, tab[1 + xor(c, x) % 256]))) % 10000 as bucket from (select distinct word from e), k),
        n as (select bucket, count(*) filter (is_target = 0) as s, count(*) filter (is_target = 1) as t from e join b using (word) group by bucket),
        g as (select bucket, cast(floor(1000 * ln(((t + 1)::double * (sum(s) over () + 10000)::double) / ((s + 1)::double * (sum(t) over () + 10000)::double))) as bigint) as gain
              from n),
        f as (select doc_id, count(*) as n_features, cast(sum(gain) as bigint) as weight from e join b using (word) join g using (bucket) where is_target = 0 group by doc_id),
        h as (select d.doc_id, coalesce(n_features, 0) as n_features, coalesce(weight, 0) as weight,
                     cast('0x' || sha256('2024:' || d.doc_id)[1:8] as bigint) as h from documents d left join f using (doc_id)),
        o as (select *, weight + cast(floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296::double))) as bigint) as score from h),
        r as (select doc_id, row_number() over (order by score desc, doc_id) as rank, count(*) over () as eligible from o where n_features >= 20)
        select doc_id, n_features, weight, score, case when rank <= eligible * 10 // 100 then rank end as rank from o left join r using (doc_id)""",
    "op13_fill_middle": """
        with t as (select doc_id, coalesce(text, '') as text, sha256('1:' || coalesce(cast(doc_id as varchar), '')) as d from documents),
        h as (select doc_id, text, length(text) as n, cast('0x' || d[1:8] as bigint) as h1, cast('0x' || d[9:16] as bigint) as h2,
                     cast('0x' || d[17:24] as bigint) as h3, cast('0x' || d[25:32] as bigint) as h4 from t),
        c as (select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
                     case when n = 0 or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= 90 then 'plain'
                          when h4 % 100 < 20 then 'spm' else 'psm' end as form from h),
        p as (select *, substring(text, 1, a) as p, substring(text, a + 1, b - a) as m, substring(text, b + 1) as s from c)
        select doc_id, n, form, case when form <> 'plain' then a end as prefix_chars, case when form <> 'plain' then b - a end as middle_chars,
               sha256(case form when 'plain' then text when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m
                      else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256, sha256(text) as restored_sha256 from p""",
}
