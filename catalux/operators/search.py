"""Ranked search over vectors, text, structured fields and file names."""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text, vectors
from . import records
from .checks import matching
from .fulltext import FIELDS, SearchIndex
from .rules import category_filter

CATEGORIES = ("image", "video", "document", "other")
PAGE_SIZES = (25, 50, 100)
LONGEST_QUERY, LONGEST_NAME, LONGEST_EXTENSION = 300, 100, 12


@dataclass(frozen=True)
class Query:
    """Search parameters. ``vectors`` names the query vector and identity per kind: {'semantic': ([...], {'model': 'm'})}."""

    q: str | None = None
    semantic: list[float] | None = None
    semantic_identity: dict[str, str] = field(default_factory=dict)
    visual: list[float] | None = None
    visual_identity: dict[str, str] = field(default_factory=dict)
    category: str | None = None
    extension: str | None = None
    limit: int | None = 25
    offset: int | None = 0
    #: Part of a file name and order, of the library page that stands for an empty query.
    name: str | None = None
    sort: str = "newest"

    @classmethod
    def of(cls, parameters: Mapping[str, str | None]) -> Query:
        """A query from request parameters. Unknown ones, categories and orders are refused; numbers that aren't any take their default."""
        known = {"page", "pageSize", "query", "category", "type", "extension", "sort", "nlq"}
        if unknown := sorted(set(parameters) - known):
            raise ValueError(f"unknown parameters: {', '.join(unknown)}")
        p = {k: v or "" for k, v in parameters.items()}
        number = lambda k, other: int(m[0]) if (m := re.match(r"\s*[+-]?[0-9]+", p.get(k, ""))) else other
        size = number("pageSize", 25)
        size = size if size in PAGE_SIZES else 25
        category, sort = parameters.get("category", parameters.get("type")) or None, p.get("sort") or "newest"
        if category is not None and category not in CATEGORIES:
            raise ValueError(f"unknown category: {category}")
        if sort not in records.SORTS:
            raise ValueError(f"unknown order: {sort}")
        ext = re.sub("[^A-Za-z0-9]", "", p.get("extension", ""))[:LONGEST_EXTENSION].lower()
        name = re.sub("[*,()]", "", p.get("query", "").strip()[:LONGEST_NAME])
        return cls(q=p.get("nlq", "").strip()[:LONGEST_QUERY] or None, category=category, extension=ext or None, limit=size, offset=(max(1, number("page", 1) or 1) - 1) * size, name=name or None, sort=sort)

    @property
    def words(self) -> str | None:
        return (self.q or "").strip() or None

    @property
    def page(self) -> tuple[int, int]:
        return max(1, min(25 if self.limit is None else self.limit, 100)), max(0, self.offset or 0)


def optional_on(left: DataFrame, right: DataFrame, key: str, **wanted: str | None) -> DataFrame:
    """Left join on ``key`` and those of ``wanted`` that are not None; a null parameter matches every identity."""
    for c, v in wanted.items():
        if v is not None:
            right = right.where(F.col(c) == v)
    return left.join(right, key, "left")


def active_assets(assets: DataFrame, destinations: DataFrame, links: DataFrame, files: DataFrame, folders: DataFrame) -> DataFrame:
    """Assets with a verified destination and a file that is there, in an active folder: two semi-joins."""
    verified = destinations.where("upload_status = 'VERIFIED' and destination_file_id is not null")
    there = files.where("not coalesce(is_missing, false) and not (sync_classification <=> 'REMOVED_FROM_SOURCE')").join(folders.where("active"), "folder_id", "left_semi")
    return assets.join(verified, "asset_id", "left_semi").join(links.join(there, "file_id", "left_semi"), "asset_id", "left_semi")


def _ppm(c: Column) -> Column:
    """Hundredths of a percent, halves up, as a whole number."""
    return F.floor(c * 10000 + 0.5).cast("long")


def _page(df: DataFrame, q: Query) -> DataFrame:
    limit, offset = q.page
    total = df.agg(F.count("*").alias("total_count"))
    top = df.orderBy(F.col("raw_score").desc(), F.col("asset_id").asc()).offset(offset).limit(limit)
    return top.crossJoin(F.broadcast(total))  # one row


def _filtered(df: DataFrame, q: Query) -> DataFrame:
    return df.where(F.lower("file_extension") == q.extension.lower()) if q.extension is not None else df


def _found(df: DataFrame, terms: SearchIndex, w: str | None) -> DataFrame:
    """c_text, near_<field> (0 or 1) and named (0 or 1), from the lists of the query's terms and trigrams."""
    if w is None:
        return df.withColumns({"c_text": F.lit(0.0), "named": F.lit(0), **{f"near_{f}": F.lit(0) for f in FIELDS}})
    out = df.join(terms.text_ranks(w), "asset_id", "left").join(terms.similar_fields(w), "asset_id", "left").join(terms.names_with(w).withColumn("named", F.lit(1)), "asset_id", "left")
    return out.withColumns({"c_text": F.coalesce("text_rank", F.lit(0.0)), "named": F.coalesce("named", F.lit(0)), **{f"near_{f}": F.coalesce(f"near_{f}", F.lit(0)) for f in FIELDS}})


def hybrid_v1(assets: DataFrame, index: DataFrame, embeddings: DataFrame, q: Query, terms: SearchIndex) -> DataFrame:
    """0.45 semantic, 0.20 text, 0.08 treatment, 0.07 subject, 0.10 doctor, 0.10 file name; capped at 1.

    ``assets``: asset_id, mime_type, file_extension, already restricted to active ones; ``index``: asset_id, indexing_status. Null identity
    parameters match every embedding of an asset, so an asset may come more than once. Scores are in hundredths of a percent.
    No text is read: ``terms`` holds the postings. A query without words or vector finds nothing.
    """
    df = optional_on(assets.join(index.where("indexing_status = 'INDEXED'").select("asset_id"), "asset_id"), embeddings, "asset_id", **q.semantic_identity)
    if q.words is None and q.semantic is None:
        df = df.limit(0)
    df = _filtered(df, q)
    if q.category is not None:
        df = df.where(category_filter(q.category))
    semantic = F.lit(0.0) if q.semantic is None else F.coalesce(vectors.cosine(F.col("embedding"), vectors.literal(q.semantic)), F.lit(0.0))
    df = _found(df, terms, q.words).withColumns({"c_semantic": semantic, "c_fields": 0.08 * F.col("near_treatment") + 0.07 * F.col("near_subject") + 0.10 * F.col("near_doctor_name"), "c_name": 0.10 * F.col("named")})
    df = df.withColumn("raw_score", F.round(0.45 * F.col("c_semantic") + 0.20 * F.col("c_text") + F.col("c_fields") + F.col("c_name"), 9))
    cols = [_ppm(F.least("raw_score", F.lit(1.0))).alias("match_score"), _ppm(F.round("c_semantic", 9)).alias("semantic_score"), _ppm(F.round("c_text", 9)).alias("text_score"), _ppm(F.round("c_fields", 9)).alias("structured_score"), _ppm(F.col("c_name")).alias("filename_score")]
    return _page(df, q).select("asset_id", *cols, "total_count")


def hybrid_v2(assets: DataFrame, index: DataFrame, visual: DataFrame, embeddings: DataFrame, q: Query, terms: SearchIndex) -> DataFrame:
    """0.65 visual, 0.15 semantic, 0.15 the larger of text and fields, 0.05 file name; between 0 and 1.

    Assets without an index row stay (``terms`` holds what is indexed, so they have no text or field score). An identity must be equal
    in all its parts, so an absent one matches nothing. A category is by MIME type only; 'document' is what is neither image nor video, 'other' nothing.
    """

    def one(df: DataFrame, identity: dict[str, str], name: str) -> DataFrame:
        same = F.lit(bool(identity))
        for c, v in sorted(identity.items()):
            same = same & (F.col(c) == v)
        return df.where(same).select("asset_id", F.col("embedding").alias(name))

    df = assets.join(one(visual, q.visual_identity, "v"), "asset_id", "left").join(one(embeddings, q.semantic_identity, "e"), "asset_id", "left")
    if q.words is None and q.visual is None and q.semantic is None:
        df = df.limit(0)
    df = _filtered(df, q)
    if q.category is not None:
        m = F.lower(F.coalesce("mime_type", F.lit("")))
        image, video = m.startswith("image/"), m.startswith("video/")
        df = df.where({"image": image, "video": video, "document": ~image & ~video}.get(q.category, F.lit(False)))
    zero = F.lit(0.0)
    score = lambda c, v: zero if v is None else F.coalesce(vectors.cosine(F.col(c), vectors.literal(v)), zero)
    fields = (F.col("near_treatment") + F.col("near_subject") + F.col("near_doctor_name")) / 3.0
    df = _found(df, terms, q.words).withColumns({"c_visual": score("v", q.visual), "c_semantic": score("e", q.semantic), "c_fields": fields, "c_name": F.col("named").cast("double")})
    df = df.withColumn("raw_score", F.round(0.65 * F.col("c_visual") + 0.15 * F.col("c_semantic") + 0.15 * F.greatest("c_text", "c_fields") + 0.05 * F.col("c_name"), 9))
    cols = [_ppm(F.least(F.greatest("raw_score", F.lit(0.0)), F.lit(1.0))).alias("match_score")] + [_ppm(F.round(f"c_{c}", 9)).alias(f"{n}_score") for c, n in (("visual", "visual"), ("semantic", "semantic"), ("text", "text"), ("fields", "structured"), ("name", "filename"))]
    return _page(df, q).select("asset_id", *cols, "total_count")


def browse(assets: DataFrame, q: Query) -> DataFrame:
    """The library page that an empty query shows: asset_id, a null match_score, total_count, in the order asked for.

    ``assets`` needs size_bytes and updated_at, and for the filters file_name, mime_type and file_extension.
    """
    limit, offset = q.page
    df = assets.where(matching(name=q.name, ext=q.extension))
    if q.category is not None:
        df = df.where(category_filter(q.category))
    return records.page(df, q.sort, offset // limit + 1, limit, "asset_id").select("asset_id", F.lit(None).cast("long").alias("match_score"), F.col("total").alias("total_count"))


def search(assets: DataFrame, index: DataFrame, visual: DataFrame, embeddings: DataFrame, q: Query, terms: SearchIndex) -> DataFrame:
    """v2 where there is a visual query vector, else v1; the library page where there is neither word nor vector."""
    if q.words is None and q.visual is None and q.semantic is None:
        return browse(assets, q)
    return hybrid_v2(assets, index, visual, embeddings, q, terms) if q.visual is not None else hybrid_v1(assets, index, embeddings, q, terms)


def cosine_topk(embeddings: DataFrame, query: list[float], k: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k nearest by cosine, ties by key; similarity in millionths."""
    sim = F.floor(vectors.cosine(F.col(vector), vectors.literal(query)) * 1_000_000 + 0.5).cast("long")
    return embeddings.select(key, sim.alias("similarity_ppm")).orderBy(F.col("similarity_ppm").desc_nulls_last(), key).limit(k)


def discovery(assets: DataFrame, index: DataFrame, fingerprint: Column, active: DataFrame) -> DataFrame:
    """(asset_id, state): NEW, CHANGED, UNCHANGED, PENDING or INELIGIBLE against the index."""
    i = index.select("asset_id", "indexing_status", "source_fingerprint", F.lit(True).alias("known"))
    a = active.select("asset_id", F.lit(True).alias("is_active")).distinct()
    ext = text.extension("file_extension")
    supported = ext.isin("jpg", "jpeg", "png", "webp", "mp4", "mov", "pdf", "pptx") & F.coalesce("is_active", F.lit(False))
    state = F.when(F.col("known") & (F.col("indexing_status") != "INDEXED"), "PENDING").when(F.col("known") & (fingerprint == F.col("source_fingerprint")), "UNCHANGED").when(~supported, "INELIGIBLE").when(F.col("known"), "CHANGED").otherwise("NEW")
    return assets.join(i, "asset_id", "left").join(a, "asset_id", "left").select("asset_id", state.alias("state"))
