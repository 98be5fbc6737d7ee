"""Free-text skills mapped to a catalogue's concepts by vectors, context and word rules."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfarer.functions.text import strip
from wayfarer.sources.shared import settled

# Words and endings of skills that are mere modifiers.
MODIFIERS = [
    "advanced", "basic", "general", "professional", "experienced", "skilled", "various", "multiple", "diverse", "extensive", "strong", "excellent", "good", "great", "intermediate", "fluent", "proficient",
    "beginner", "expert", "entry-level", "senior-level", "expert-level", "computer-literate", "tech-savvy", "self-motivated", "self-starter", "team-player", "highly-motivated", "motivated", "detail-oriented",
]
ENDINGS = ["-based", "-related", "-friendly", "-oriented", "-driven", "-focused", "-savvy", "-literate", "-motivated", "-minded"]
# Concepts that are never a result, by the last segment of their uri.
NEVER = [
    "cf6ca1fc-f2be-4deb-bb35-1fffe4099023", "6d56955d-2b6c-471f-890d-8c17ab16053b", "96a6b597-fc62-487e-87f2-de5b67950a3a", "5d2e82cc-5943-4218-a459-a1956fad2b63",
    "f7e051fc-8f7b-45b3-8911-8ffb9b951f4a", "79c012c7-4b09-497e-8152-e73e5d1d3384", "ec970529-8900-404f-95aa-7521551e964f", "06ec0ecb-87fc-47a4-8348-81df2470ff3d",
]
# Domains that a label may be bound to, and the words in a context that bear each out.
DOMAINS = {
    "nursing": ["nurse", "nursing"],
    "maritime": ["maritime", "ship", "vessel", "naval", "sailor"],
    "aviation": ["aircraft", "airline", "aviation", "flight", "airport"],
    "tourism": ["tourism", "tourist", "travel agency", "tour operator", "sightseeing"],
    "hospitality": ["hospitality", "hotel", "restaurant", "guest", "concierge", "lodging", "kitchen", "culinary", "chef", "cook", "catering", "dining", "cuisine", "menu"],
    "healthcare": ["healthcare", "physician", "doctor", "nurse", "nursing", "hospital"],
    "social work": ["social work", "social worker", "case worker", "caseworker", "welfare", "counseling", "counsellor"],
    "social service": ["social services", "social service", "case worker", "caseworker", "welfare"],
    "social services": ["social services", "case worker", "caseworker", "welfare"],
    "veterinary": ["veterinary", "veterinarian", "animal", "pet"],
    "clinical": ["clinical trial", "clinical research", "clinical study", "clinical care", "clinical setting", "clinical experience", "clinical practice"],
    "outdoor": ["outdoor", "wilderness", "hiking", "camp", "camping", "expedition", "ranger"],
    "pilot": ["aircraft", "flight", "aviation"],
    "pilots": ["aircraft", "flight", "aviation"],
    "forestry": ["forestry", "forest", "timber", "woodland"],
    "coastal": ["coast", "coastal", "shoreline", "seaside"],
    "agricultural": ["agriculture", "agricultural", "farm", "farming", "crops", "livestock"],
    "correctional": ["correctional", "corrections", "prison", "jail", "inmate", "warden"],
    "warehouse": ["warehouse", "stockroom", "fulfillment center", "distribution center"],
}

#: A mapping's least score, and how many concepts are looked at before labels are held against the context.
LEAST, LOOKED_AT = 0.6, 20
#: Weights of a concept's best label and of its description.
LABEL_SHARE, TEXT_SHARE = 0.85, 0.15


def is_modifier(skill: Column) -> Column:
    """A skill that is an adjective and no more."""
    low = F.lower(strip(skill))
    return low.isin(MODIFIERS) | low.rlike("(" + "|".join(map(re.escape, ENDINGS)) + ")$")


def domain_of(label: Column) -> Column:
    """The first domain that a label is bound to by in, of or for, an article between them or not; null for none."""
    names = sorted(DOMAINS, key=len, reverse=True)
    spelled = "|".join(n.replace(" ", r"\s+") for n in names)
    found = F.regexp_extract(F.lower(label), rf"(?U)\b(?:in|of|for)\s+(?:(?:a|an|the)\s+)?({spelled})\b", 1)
    return F.nullif(F.regexp_replace(found, r"(?U)\s+", " "), F.lit(""))


def borne_out(label: Column, context: Column) -> Column:
    """Whether a label has no domain, or its context has a word of that domain.

    Terms of several words are looked for anywhere, single ones as whole words.
    """
    low = F.lower(F.coalesce(context, F.lit("")))
    words = F.regexp_extract_all(low, F.lit(r"(?U)\b([\w']+)\b"), F.lit(1))
    terms = F.create_map(*[x for d, ts in DOMAINS.items() for x in (F.lit(d), F.array(*map(F.lit, ts)))])
    asked = F.element_at(terms, domain_of(label))
    # A lambda over a split context would split it again for each term: it is an array of one.
    met = F.exists(F.array(F.struct(words.alias("w"), low.alias("t"))), lambda c: F.exists(asked, lambda x: F.when(F.contains(x, F.lit(" ")), F.contains(c["t"], x)).otherwise(F.array_contains(c["w"], x))))
    return F.coalesce(met, F.lit(True))


def allowed(concepts: DataFrame, uri: str = "uri") -> DataFrame:
    """Concepts without those that are never a result."""
    return concepts.where(~F.coalesce(F.element_at(F.split(F.col(uri), "/"), -1).isin(NEVER), F.lit(False)))


FOUND = "query long, concept long, label_id long, score double"


def best_concepts(queries: DataFrame, labels: DataFrame, concepts: DataFrame, k: int, rows: int, most: int = 20_000) -> DataFrame:
    """(query, concept, label_id, score, rank): the k best concepts of each query.

    A concept's score mixes its best label's inner product (ties to the smaller
    label) with its own; ``queries.concrete`` marks those that go by labels alone.
    Ties go to the smaller concept. Labels and concepts lie in blocks of about
    ``most`` of the ``rows`` labels, queries in blocks of as many; each block meets
    each and keeps its own k best of every query.
    """
    blocks, turns = max(1, -(-rows // most)), max(1, -(-queries.count() // most))

    def block(left: pa.Table, right: pa.Table) -> pa.Table:
        out: dict[str, list] = {"query": [], "concept": [], "label_id": [], "score": []}
        if left.num_rows and right.num_rows:
            order = left.sort_by([("concept", "ascending"), ("id", "ascending")])
            own = np.array(order.column("own").to_pylist(), bool)
            ids, concept = order.column("id").to_numpy(), order.column("concept").to_numpy()
            matrix, ask = (np.array(c.to_pylist(), np.float64).reshape(len(c), -1) for c in (order.column("vec"), right.column("ask")))
            plain, names = np.flatnonzero(~own), np.flatnonzero(own)
            # Concepts with both a vector of their own and a label.
            some, of_name, heads = np.intersect1d(concept[names], concept[plain], return_indices=True)
            heads_all = np.flatnonzero(np.diff(concept[plain], prepend=np.iinfo(np.int64).min))
            ends = np.append(heads_all[1:], len(plain))[np.searchsorted(heads_all, heads)]
            concrete, query = right.column("concrete").to_numpy(zero_copy_only=False), right.column("query").to_numpy()
            for at in range(0, len(ask) if len(some) else 0, 256):
                q = ask[at : at + 256]
                by_label = q @ matrix[plain].T
                best = np.maximum.reduceat(by_label, heads_all, axis=1)[:, np.searchsorted(heads_all, heads)]
                text = q @ matrix[names[of_name]].T
                score = np.where(concrete[at : at + 256, None], best, LABEL_SHARE * best + TEXT_SHARE * text)
                top = np.argsort(-score, axis=1, kind="stable")[:, :k]
                for r, chosen in enumerate(top):
                    for c in chosen:
                        a, b = heads[c], ends[c]
                        out["query"].append(int(query[at + r]))
                        out["concept"].append(int(some[c]))
                        out["label_id"].append(int(ids[plain[a + int(by_label[r, a:b].argmax())]]))
                        out["score"].append(float(score[r, c]))
        return pa.table(out, schema=pa.schema([("query", pa.int64()), ("concept", pa.int64()), ("label_id", pa.int64()), ("score", pa.float64())]))

    place = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    bank = labels.select(F.col("concept").cast("long").alias("concept"), F.col("id").cast("long").alias("id"), "vec", F.lit(False).alias("own"))
    bank = bank.unionByName(concepts.select(F.col("concept").cast("long").alias("concept"), F.lit(-1).cast("long").alias("id"), F.col("vec").cast(dict(labels.dtypes)["vec"]).alias("vec"), F.lit(True).alias("own")))
    left = bank.withColumn("b", place("concept", blocks)).withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(turns - 1))))
    # New names, as both sides may come from one table.
    right = queries.select("query", F.col("vec").alias("ask"), "concrete", place("query", turns).alias("t"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"))
    found = left.groupBy("b", "t").cogroup(right.groupBy("b", "t")).applyInArrow(block, FOUND)
    order = Window.partitionBy("query").orderBy(F.desc("score"), "concept")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mapped_skills(skills: DataFrame, labels: DataFrame, concepts: DataFrame, overrides: DataFrame, concrete: list[str], least: float = LEAST) -> DataFrame:
    """(user, position, skill, uri, label): the concepts of each user's skills.

    ``skills`` has user, position, skill, context and vec; ``labels`` concept, id, label
    and vec; ``concepts`` concept, uri, name and vec; ``overrides`` name and uri of
    skills that go to a concept unasked; ``concrete`` names tools.

    Skills are trimmed, blank ones and modifiers go, and of equal ones the first
    stays. Of the best 20 concepts, those whose best label is bound to a domain that
    the context doesn't bear out are left out; the best one left counts if its score
    reaches ``least``. Of skills with the same concept the first stays.
    """
    bare = skills.withColumn("skill", strip(F.col("skill"))).where("skill != ''").where(~is_modifier(F.col("skill")))
    first = Window.partitionBy("user", "skill").orderBy("position")
    bare = bare.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r")
    given = overrides.groupBy(F.lower(strip(F.col("name"))).alias("_name")).agg(F.min("uri").alias("_given"))
    bare = settled(bare.join(given, F.lower("skill") == F.col("_name"), "left").drop("_name").withColumn("query", F.xxhash64("user", "position", "skill")), "skills")

    fine = allowed(concepts)
    asked = bare.where("_given is null").select("query", "vec", F.lower("skill").isin([c.lower() for c in concrete]).alias("concrete"))
    near = best_concepts(asked, labels.join(fine.select("concept"), "concept", "left_semi"), fine, LOOKED_AT, labels.count())
    near = near.join(labels.select(F.col("id").alias("label_id"), F.col("label").alias("_label")), "label_id").join(bare.select("query", "context"), "query")
    kept = near.where(borne_out(F.col("_label"), F.col("context")))
    top = kept.groupBy("query").agg(F.min_by(F.struct("concept", "score"), "rank").alias("t")).where(F.col("t.score") >= least).select("query", F.col("t.concept").alias("concept"))
    top = top.join(concepts.select("concept", F.col("uri").alias("_found")), "concept").select("query", "_found")
    done = bare.join(top, "query", "left").withColumn("uri", F.coalesce("_given", "_found")).where("uri is not null")
    once = Window.partitionBy("user", "uri").orderBy("position")
    done = done.withColumn("_r", F.row_number().over(once)).where("_r = 1")
    names = concepts.groupBy("uri").agg(F.min("name").alias("label"))
    return done.join(names, "uri", "left").select("user", "position", "skill", "uri", F.coalesce("label", F.lit("")).alias("label"))
