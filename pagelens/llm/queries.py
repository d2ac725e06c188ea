"""The subpackage's queries over the given tables, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audio, backoff, html_text, mixing, near_dedup, neighbours, packing, phrases, pii, quality, runs, token_counts, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document."""
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    return quality.scored(docs, quality.fit(docs, labels))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of documents."""
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in windows of 2048 tokens."""
    pieces = packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def _recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio.recordings_of(audio.with_versions(_table(spark, sf_dir, "embeddings")), played="played")


def op6_audio_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector played as a recording, three of ten as versions of another; classes of equal fingerprints and the best alignment of every fiftieth."""
    return audio.align(_recordings(spark, sf_dir))


def op6_audio_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All alignments of the classes of every fiftieth recording with other classes."""
    return audio.matches(_recordings(spark, sf_dir))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of each document."""
    mixed = mixing.mix(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document before and after edits derived from its own values."""
    docs = token_counts.derived_edits(_table(spark, sf_dir, "documents"))
    return token_counts.counts_after_edits(docs, public_tokenizers.path("word_bpe_49k.json"))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_text.main_texts(_table(spark, sf_dir, "pages"))


def op8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors of every hundredth."""
    return neighbours.search(_table(spark, sf_dir, "embeddings"))


def op9_backoff_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stupid-backoff score of every document under the counts of all others."""
    return backoff.scores(_table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document."""
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    return toxicity.scored(docs, toxicity.fit(docs, labels))


def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    spans = F.col("spans")
    counts = [F.size(pii.of_kinds(spans, (kind,))).cast("long").alias(f"n_{kind}") for kind in pii.BASE]
    found = pii.find_pii(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", *counts, F.sha2(pii.listed(pii.of_kinds(spans, pii.BASE)), 256).alias("base_sha256"), pii.listed(spans).alias("spans"))


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The phrases of every language whose words belong together most."""
    return phrases.collocations(_table(spark, sf_dir, "documents"))


def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of every document, every tenth of which is made to end in repetitions."""
    found = runs.find_runs(runs.periodic_tails(_table(spark, sf_dir, "documents")))
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period"))), F.lit("\n")))
    most = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("shorter"), r["start"].alias("start"), r["period"].alias("period"))))
    best = found.withColumn("best", most)
    return best.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        (-F.col("best.shorter")).alias("length"),
        "best.period",
        F.floor(-1000 * F.col("best.shorter") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality,
        op2_simhash_near_dedup,
        op3_packing,
        op4_token_counts,
        op5_html_text,
        op6_audio_fingerprints,
        op6_audio_matches,
        op7_mixing,
        op8_neighbours,
        op9_backoff_scores,
        op10_toxicity,
        op11_pii,
        op12_phrases,
        op13_runs,
    )
}

_DRAWS = ", ".join(
    f"('0x' || substr(md5('mix{i}:' || coalesce(doc_id::varchar, '')), {8 * k + 1}, 8))::bigint::double / {float(16**8)}"
    for i in range(mixing.SEEDS // 4)
    for k in range(4)
)

SQL: dict[str, str] = {
    "op7_mixing": f"""
with sized as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size, [{_DRAWS}] as u from documents
), sums as (
  select source, sum(size)::bigint as source_size from sized group by source
), weighed as (
  select *, ([3.0, 1.0, 2.0])[((row_number() over (order by source nulls last) - 1) % 3 + 1)::int]::double as weight, source_size * 2.0::double as cap from sums
), levels as (
  select *, (sum(source_size) over () * 1.5::double
    - coalesce(sum(cap) over (order by cap / weight, source nulls last rows between unbounded preceding and 1 preceding), 0.0))
    / sum(weight) over (order by cap / weight, source nulls last rows between current row and unbounded following) as level from weighed
), targets as (
  select source, source_size, least(cap, coalesce((select max(level) from levels where level * weight <= cap) * weight, cap))::double as target from levels
), rated as (
  select *, case when source_size > 0 then target / source_size else 0.0 end::double as rate from targets
), tries as (
  select r.source, k, abs(sum((floor(r.rate) + (s.u[k + 1] < r.rate - floor(r.rate))::int) * s.size) - any_value(r.target)) as miss
  from sized s join rated r on s.source is not distinct from r.source, range(0, {mixing.SEEDS}) t(k) group by r.source, k
), chosen as (
  select source, arg_min(k, (miss, k)) as seed from tries group by source
)
select s.doc_id, s.size, r.source_size, r.target,
  (floor(r.rate) + (s.u[c.seed + 1] < r.rate - floor(r.rate))::int)::bigint * s.size as taken
from sized s join rated r on s.source is not distinct from r.source join chosen c on s.source is not distinct from c.source
""",
    "op12_phrases": r"""
with pieces as (
  select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents
), worded as (
  select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from pieces
), grams as (
  select lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) as phrase from worded, range(1, 4) t(k)
), counts as (
  select lang, k, phrase, count(*) as f from grams group by all having count(*) >= 10
), sizes as (
  select lang, count(*) as n from grams where k = 1 group by lang
), several as (
  select lang, k, phrase, string_split(phrase, ' ') as w, f as a from counts where k > 1
), inside as (
  select lang, phrase, max(a) as longer from (
    select lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) as phrase from several where k = 3
  ) group by lang, phrase
), cuts as (
  select s.lang, s.phrase, s.a, c.cut, array_to_string(s.w[1:c.cut], ' ') as head, array_to_string(s.w[c.cut + 1:], ' ') as rest
  from several s left join inside i using (lang, phrase), range(1, 3) c(cut)
  where c.cut < s.k and not coalesce(100 * i.longer >= 50 * s.a, false)
), scored as (
  select c.lang, c.phrase, c.a, l.f as l, r.f as r, c.cut, (1000000::hugeint * c.a * c.a // (l.f::hugeint * r.f))::bigint as score
  from cuts c join counts l on l.lang = c.lang and l.phrase = c.head join counts r on r.lang = c.lang and r.phrase = c.rest
), lowest as (
  select * from scored qualify row_number() over (partition by lang, phrase order by score, cut) = 1
)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score
from lowest join sizes using (lang) qualify rank <= 2000
""",
}
