"""Queries around the token classifier. Its weights are an input; embeddings stand in for logits."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageguard.functions import masking
from pageguard.operators import ner
from pageguard.plans.pii import SPACE_SQL
from pageguard.sources.tables import table

_TYPE_SAMPLES = ["PERSON", "given_name", "Tel", "credit-card number", "IPV6", "IP_ADDRESS", "IBAN_CODE", "IMEI", "LOC", "org", "email address", "per", "URL", "", "Phone IMEI", "country"]


def _logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.transform(F.slice("embedding", 1, 51), lambda x: x.cast("double") * 40).alias("logits"))


def ner_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = ner.best_label(F.col("logits"))
    return _logits(spark, sf_dir).select("vec_id", best.alias("label"), ner.label_name(best).alias("name"))


def ner_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _logits(spark, sf_dir).select("vec_id", F.round(ner.best_share(F.col("logits")), 9).alias("confidence"))


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("vec_id")
    name = ner.label_name(ner.best_label(F.col("logits")) % 5)
    prefix, kind = ner.parse_label(name)
    at = k % 20
    return _logits(spark, sf_dir).select(F.floor(k / 20).alias("doc_id"), at.alias("pos"), (at * 6).alias("start"), (at * 6 + 5).alias("end"), prefix.alias("prefix"), kind.alias("entity_type"), ner.best_share(F.col("logits")).alias("confidence"))


def bio_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ner.merge_spans(_labels(spark, sf_dir), "doc_id", 0.5).withColumn("confidence", F.round("confidence", 9))


def bio_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = F.array(*map(F.lit, ["O", "0", "b-person", " I-ORG ", "I_LOC", "PERSON", "B-", "X-PER", ""]))
    rows = table(spark, sf_dir, "nation").select("n_nationkey", F.element_at(labels, (F.col("n_nationkey") % 9 + 1).cast("int")).alias("label"))
    prefix, kind = ner.parse_label(F.col("label"))
    return rows.select("n_nationkey", prefix.alias("prefix"), kind.alias("entity_type"))


def entity_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "nation").select("n_nationkey", F.element_at(F.array(*map(F.lit, _TYPE_SAMPLES)), (F.col("n_nationkey") % 16 + 1).cast("int")).alias("raw"))
    return rows.select("n_nationkey", ner.normalize_type(F.col("raw")).alias("detector"), ner.normalize_type(F.col("raw"), wide=True).alias("fixed"), ner.normalize_type(F.col("raw"), wide=True, compat=True).alias("compat"))


def ner_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans over the nations' names as masked items, by type."""
    docs = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("doc_id"), F.initcap(F.repeat(F.concat("n_name", F.lit(" ")), 20)).alias("text"))
    spans = bio_spans(spark, sf_dir).join(docs, "doc_id")
    kind = F.when(F.col("entity_type") == "AGE", "NAME").otherwise(F.col("entity_type"))
    piece = F.substring(F.col("text"), F.col("start") + 1, F.col("end") - F.col("start"))
    return spans.select("doc_id", kind.alias("type"), F.col("start"), masking.mask(kind, piece).alias("masked"))


def basic_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.size(ner.tokens(F.col("text"))).cast("long").alias("n_tokens"))


def token_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letters in tokens and the end of the last one, from the token table."""
    t = ner.token_table(table(spark, sf_dir, "documents"), "doc_id", "text")
    return t.groupBy("doc_id").agg(F.count("*").alias("n_tokens"), F.sum(F.col("end") - F.col("begin")).alias("chars"), F.max("end").alias("last_end"))


def rule_vocabulary() -> dict[str, int]:
    """A small vocabulary by rule, in place of the model's own: specials, characters and pairs of letters."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    pieces = ["[PAD]", "[UNK]", "[CLS]", "[SEP]", *map(chr, range(33, 127))]
    pieces += [f"##{c}" for c in letters] + [a + b for a in letters for b in "aeiou"] + [f"##{a}{b}" for a in letters for b in "aeiou"]
    return {p: i for i, p in enumerate(dict.fromkeys(pieces))}


def wordpiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ner.encode_pieces(table(spark, sf_dir, "documents"), "doc_id", "text", rule_vocabulary())
    return out.select("doc_id", "n_pieces", F.size("input_ids").cast("long").alias("n_inputs"), F.array_join("input_ids", ",").alias("ids"))


def rule_model():
    """A stand-in for the classifier: pieces of a consonant and `a` begin a person, continuing pieces go on with it."""
    vocab = rule_vocabulary()
    begins = {i for p, i in vocab.items() if len(p) == 2 and p[1] == "a"}
    goes_on = {i for p, i in vocab.items() if p.startswith("##")}
    person = 2 * ner.MODEL_TYPES.index("PERSON") + 1
    rows = np.zeros((len(vocab), 51), np.float32)
    for i in vocab.values():
        rows[i, person if i in begins else person + 1 if i in goes_on else 0] = 10.0
    return lambda ids, masks, types: [rows[x] for x in ids]


def ner_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of whole documents: tokens, pieces in overlapping chunks, labels of a model by rule, merged spans, masks."""
    found = ner.text_items(table(spark, sf_dir, "documents"), "doc_id", "text", rule_vocabulary(), rule_model)
    return found.withColumn("confidence", F.round("confidence", 6))


QUERIES = {f.__name__: f for f in (ner_argmax, ner_confidence, bio_spans, bio_parse, entity_normalize, ner_items, basic_tokens, token_offsets, wordpiece, ner_documents)}

_TYPES = ", ".join(f"'{t}'" for t in ner.MODEL_TYPES)
_BEST = "with l as (select vec_id, list_transform(embedding[1:51], lambda x: x::double * 40) as z from embeddings), b as (select vec_id, z, list_max(z) as m, list_position(z, list_max(z)) - 1 as k from l)"
_SPANS = f"""{_BEST}, t as (select vec_id // 20 as doc_id, vec_id % 20 as pos, k % 5 as j, 1 / list_sum(list_transform(z, lambda x: exp(x - m))) as c from b),
  a as (select *, case when j in (1, 2) then 'AGE' when j in (3, 4) then 'COORDINATE' end as kind, c >= 0.5 and j > 0 as ok from t),
  s as (select *, ok and (j % 2 = 1 or not coalesce(lag(ok) over w, false) or lag(kind) over w <> kind) as starts from a window w as (partition by doc_id order by pos)),
  g as (select *, sum(starts::int) over (partition by doc_id order by pos) as span from s),
  spans as (select doc_id, any_value(kind) as entity_type, min(pos) * 6 as start, max(pos) * 6 + 5 as "end", round(avg(c), 9) as confidence from g where ok group by doc_id, span)"""
_TOK = rf"[!-/:-@\[-`{{-~]|[^{SPACE_SQL}!-/:-@\[-`{{-~]+"
_DETECTOR = ["NAME", "GIVEN_NAME", "PHONE", "CREDIT-CARD NUMBER", "IP_ADDRESS", "IP_ADDRESS", "IBAN_CODE", "IMEI", "LOC", "ORG", "EMAIL ADDRESS", "PER", "URL", "", "PHONE", "COUNTRY"]
_DETECTOR[1], _DETECTOR[3] = "NAME", "CARD"
_FIXED = ["NAME", "NAME", "PHONE", "CARD", "IP_ADDRESS", "IP_ADDRESS", "IBANCODE", "IMEI", "LOCATION", "ORGANIZATION", "EMAIL", "NAME", "URL", "UNKNOWN", "PHONE", "LOCATION"]
_COMPAT = ["NAME", "NAME", "PHONE", "CARD", "PV6", "PADDRESS", "BANCODE", "MEI", "LOCATION", "ORGANIZATION", "EMAIL", "NAME", "URL", "UNKNOWN", "PHONE", "LOCATION"]
_PICK = lambda xs: f"{xs}[n_nationkey % {len(xs)} + 1]"

# Of the vocabulary by rule: a token is known if letters follow its first character; pieces are then pairs or single characters.
_KNOWN = "regexp_full_match(lower({w}), '[!-~][a-z]*')"
_PIECES = "regexp_extract_all(lower({w}), '[a-z][aeiou]|[!-~]', 0)"
_PIECE_ID = "case when len(p) = 2 then 5 * (ascii(p) - 97) + instr('aeiou', p[2]) - 1 + case when i = 1 then 124 else 254 end when i = 1 then ascii(p) - 29 else ascii(p) + 1 end"

ORACLE_SQL = {
    "wordpiece": f"""with t as (select doc_id, flatten(list_transform(coalesce(regexp_extract_all(text, '{_TOK}', 0), []),
        lambda w: case when {_KNOWN.format(w='w')} then list_transform({_PIECES.format(w='w')}, lambda p, i: {_PIECE_ID}) else [1] end)) as ids from documents)
      select doc_id, len(ids)::bigint as n_pieces, least(len(ids), 254)::bigint + 2 as n_inputs, array_to_string(list_concat([2], ids[:254], [3]), ',') as ids from t""",
    "ner_documents": f"""with s as (select doc_id, unnest(ws) as w, unnest(range(1, len(ws) + 1)) as i from (select doc_id, regexp_extract_all(text, '{_TOK}|[{SPACE_SQL}]+', 0) as ws from documents)),
      o as (select doc_id, w, sum(len(w)) over (partition by doc_id order by i rows unbounded preceding) - len(w) as place, {_PIECES.format(w='w')}[1] as p from s),
      k as (select *, case when p[2] = 'a' then 0 else len(p) end as cut from o where {_KNOWN.format(w='w')}),
      m as (select doc_id, (place + cut)::bigint as start, (place + len(w))::bigint as "end", w[cut + 1:] as match from k where cut < len(w))
      select doc_id, 'NAME' as type, start, "end", match, left(match, 1) || repeat('*', len(match) - 1) as masked, round(1 / (1 + 50 * exp(-10)), 6) as confidence from m""",
    "ner_argmax": f"{_BEST} select vec_id, k as label, case when k = 0 then 'O' else case when k % 2 = 1 then 'B-' else 'I-' end || [{_TYPES}][(k + 1) // 2] end as name from b",
    "ner_confidence": f"{_BEST} select vec_id, round(1 / list_sum(list_transform(z, lambda x: exp(x - m))), 9) as confidence from b",
    "bio_spans": f"{_SPANS} select * from spans",
    "bio_parse": f"select n_nationkey, {_PICK(['O', 'O', 'B', 'I', 'I', 'B', 'B', 'B', 'O'])} as prefix, {_PICK(['O', 'O', 'PERSON', 'ORG', 'LOC', 'PERSON', 'B-', 'X-PER', 'O'])} as entity_type from nation",
    "entity_normalize": f"select n_nationkey, {_PICK(_DETECTOR)} as detector, {_PICK(_FIXED)} as fixed, {_PICK(_COMPAT)} as compat from nation",
    "ner_items": f"""{_SPANS}, n as (select n_nationkey as doc_id, repeat(array_to_string(list_transform(string_split(n_name, ' '), lambda w: upper(left(w, 1)) || lower(substr(w, 2))), ' ') || ' ', 20) as text from nation)
      select s.doc_id, case entity_type when 'AGE' then 'NAME' else entity_type end as type, start,
      case entity_type when 'AGE' then substr(text, start + 1, 1) || repeat('*', length(substr(text, start + 1, "end" - start)) - 1) else '[REDACTED]' end as masked from spans s join n on n.doc_id = s.doc_id""",
    "basic_tokens": f"select doc_id, coalesce(len(regexp_extract_all(text, '{_TOK}', 0)), 0)::bigint as n_tokens from documents",
    "token_offsets": f"""with t as (select doc_id, text, regexp_extract_all(text, '{_TOK}', 0) as ts from documents)
      select doc_id, len(ts)::bigint as n_tokens, list_sum(list_transform(ts, lambda x: length(x)))::bigint as chars, length(regexp_replace(text, '[{SPACE_SQL}]+$', ''))::bigint as last_end from t where len(ts) > 0""",
}
