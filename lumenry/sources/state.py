"""Reading posts, and keeping state as versioned Parquet: upserts, the archive, the cursor."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as t

SECRET = re.compile("token|secret|authorization|bearer", re.I)
MEDIA = "array<struct<media_key:string,type:string,url:string>>"
POST = "id string, text string, created_at string, note_tweet struct<text:string>, attachments struct<media_keys:array<string>>, entities struct<urls:array<struct<url:string,expanded_url:string>>>"


def read_posts(spark: SparkSession, path: str) -> DataFrame:
    """(post_id, text, posted_at, media_keys, urls, media) of JSON files: {"data": [...]}, {"data": {...}}, [...] or one object.

    A longer note stands for its text. Files that can't be parsed give no rows. Files are
    read whole, one task a file.
    """
    raw = spark.read.text(path, wholetext=True)
    many = F.from_json("value", f"struct<data:array<struct<{_fields()}>>,includes:struct<media:{MEDIA}>>")
    one = F.from_json("value", f"struct<data:struct<{_fields()}>>")
    bare = F.from_json("value", f"array<struct<{_fields()}>>")
    single = F.from_json("value", f"struct<{_fields()}>")
    found = F.when(F.trim("value").startswith("["), bare).when(F.size(F.filter(many["data"], lambda p: p["id"].isNotNull())) > 0, many["data"]).when(one["data"]["id"].isNotNull(), F.array(one["data"])).when(single["id"].isNotNull(), F.array(single))
    rows = raw.select(F.explode(F.filter(found, lambda p: p["id"].isNotNull())).alias("p"), many["includes"]["media"].alias("media"))
    text = F.coalesce(F.nullif(F.trim("p.note_tweet.text"), F.lit("")), "p.text")
    return rows.select(
        F.col("p.id").alias("post_id"), text.alias("text"), F.try_to_timestamp("p.created_at").alias("posted_at"),
        F.col("p.attachments.media_keys").alias("media_keys"), F.transform("p.entities.urls", lambda u: F.coalesce(u["expanded_url"], u["url"])).alias("urls"), "media",
    )


def _fields() -> str:
    return re.sub(r"(^|, )(\w+) ", r"\1\2:", POST)


def newest(posts: DataFrame, since: str | None = None, limit: int | None = None) -> DataFrame:
    """Posts, newest first; with a numeric ``since`` only those of larger numeric ids."""
    out = posts
    if since is not None and since.isdigit():
        out = out.filter(F.col("post_id").rlike("^[0-9]+$") & (F.col("post_id").try_cast("decimal(38,0)") > F.lit(since).cast("decimal(38,0)")))
    out = out.orderBy(F.desc("posted_at"), F.desc("post_id"))
    return out if limit is None else out.limit(limit)


def attach_media(posts: DataFrame, media: DataFrame) -> DataFrame:
    """Posts with the media of their keys, in the keys' order; keys without media are left out."""
    keys = posts.select("post_id", F.posexplode("media_keys").alias("pos", "media_key"))
    held = keys.join(media, "media_key").groupBy("post_id").agg(F.array_sort(F.collect_list(F.struct("pos", "media_key", "url"))).alias("attached"))
    return posts.join(held, "post_id", "left")


def cursor(ids: DataFrame, column: str = "post_id") -> DataFrame:
    """One row: the largest numeric id, else the last id in text order."""
    number = F.when(F.col(column).rlike("^[0-9]+$"), F.col(column).try_cast("decimal(38,0)"))
    return ids.agg(F.coalesce(F.max(number).cast("string"), F.max(column)).alias("cursor"))


def upserted(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those of equal keys; of rows that repeat a key in ``new`` the largest counts."""
    once = new.groupBy(key).agg(F.max(F.struct(*new.columns)).alias("r")).select("r.*")
    return old.join(once.select(key), key, "left_anti").unionByName(once, allowMissingColumns=True)


def archive_merge(old: DataFrame, new: DataFrame, key: str, cells: list[str]) -> tuple[DataFrame, DataFrame]:
    """The merged archive, and one row (n_added, n_updated, n_kept): writing can be left out where nothing changed."""
    # of rows that repeat a key the largest counts
    o, n = (df.groupBy(key).agg(F.max(F.struct(*cells)).alias(name)) for df, name in ((old, "old"), (new, "new")))
    both = o.join(n, key, "full_outer")
    counts = both.agg(
        F.count_if(F.col("old").isNull()).alias("n_added"),
        F.count_if(F.col("old").isNotNull() & F.col("new").isNotNull() & ~F.col("old").eqNullSafe(F.col("new"))).alias("n_updated"),
        F.count_if(F.col("new").isNull() | F.col("old").eqNullSafe(F.col("new"))).alias("n_kept"),
    )
    return both.select(key, F.coalesce("new", "old").alias("row")).select(key, "row.*"), counts


def write_version(df: DataFrame, path: str) -> str:
    """Writes a new version next to the older ones and returns its folder; readers of an older one aren't disturbed."""
    where = f"{path.rstrip('/')}/v-{uuid.uuid4().hex}"
    df.write.parquet(where)
    return where


def kept_first(old: DataFrame, new: DataFrame, key: str, first: list[str]) -> DataFrame:
    """``upserted``, but the columns ``first`` keep the value that they once had (as the time of processing does)."""
    held = old.select(key, *[F.col(c).alias(f"_{c}") for c in first])
    out = new.join(held, key, "left").withColumns({c: F.coalesce(f"_{c}", c) for c in first}).drop(*[f"_{c}" for c in first])
    return upserted(old, out.select(new.columns), key)


def migrated(df: DataFrame, columns: dict[str, tuple[str, Column]]) -> DataFrame:
    """Adds the columns (type, default) that an older table lacks, and fills nulls of those by the default."""
    return df.withColumns({c: F.coalesce(F.col(c).cast(kind) if c in df.columns else F.lit(None).cast(kind), default.cast(kind)) for c, (kind, default) in columns.items()})


def latest_record(records: DataFrame) -> DataFrame:
    """The row of the largest id: those that begin with a digit by number, before others; then by time, then by id."""
    number = F.when(F.col("post_id").rlike("^[0-9]"), F.regexp_extract("post_id", "^[0-9]+", 0).try_cast("decimal(38,0)"))
    return records.orderBy(number.desc_nulls_last(), F.desc_nulls_last("posted_at"), F.desc("post_id")).limit(1)


def record_order() -> list[Column]:
    """Numeric ids first, the largest first; then the latest, then by id."""
    number = F.when(F.col("post_id").rlike("^[0-9]+$"), F.col("post_id").try_cast("decimal(38,0)"))
    return [number.isNull(), number.desc_nulls_last(), F.desc_nulls_last("posted_at"), F.desc("post_id")]


def state_order(time: str, key: str) -> list[Column]:
    """As state is listed: by time, rows without one first, then by key."""
    return [F.asc_nulls_first(time), F.col(key)]


def in_state_order(df: DataFrame, time: str, key: str) -> DataFrame:
    return df.orderBy(*state_order(time, key))


def read_public(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows, errors) of published JSON, an array of objects a file. No file gives no rows and no error; a malformed one an error."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not spark._jsc or not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], schema), spark.createDataFrame([], "file string, error string")
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.from_json("value", f"array<struct<{re.sub(r'(^|, )([^ ]+) ', r'\1\2:', schema)}>>").alias("rows"))
    errors = raw.filter("rows is null").select("file", F.lit("malformed JSON").alias("error"))
    return raw.select(F.explode("rows").alias("r")).select("r.*"), errors


def read_labelled(spark: SparkSession, path: str, labels: str) -> DataFrame:
    """Labelled examples: posts as ``read_posts`` reads them, with the object ``expected`` (fields: ``labels``) of each file."""
    raw = spark.read.text(path, wholetext=True)
    found = F.from_json("value", f"struct<post:struct<id:string,text:string,created_at:string>,expected:struct<{re.sub(r'(^|, )([^ ]+) ', r'\1\2:', labels)}>>")
    return raw.select(found.alias("f")).filter("f.post.id is not null").select(F.col("f.post.id").alias("post_id"), F.col("f.post.text").alias("text"), F.try_to_timestamp("f.post.created_at").alias("posted_at"), "f.expected")


def write_if_changed(df: DataFrame, counts: DataFrame, path: str) -> str | None:
    """A new version of the archive, only where rows were added or updated; else None."""
    told = counts.first()
    return write_version(df, path) if told.n_added or told.n_updated else None


def write_samples(df: DataFrame, path: str, order: list[str], most: int = 100) -> None:
    """The first ``most`` rows as JSON, without secret-like fields: samples to look at, so the number is what they are."""
    df.select(*scrubbed(df.schema)).orderBy(*order).limit(most).coalesce(1).write.mode("overwrite").json(path)


def scrubbed(schema: t.StructType, prefix: str = "") -> list[Column]:
    """Columns of a schema without fields of secret-like names, at any depth of structs, arrays and maps."""
    return [_clean(F.col(f"{prefix}`{f.name}`"), f.dataType).alias(f.name) for f in schema.fields if not SECRET.search(f.name)]


def _clean(value: Column, kind: t.DataType) -> Column:
    if isinstance(kind, t.StructType):
        fields = [f for f in kind.fields if not SECRET.search(f.name)]
        return F.when(value.isNotNull(), F.struct(*[_clean(value.getField(f.name), f.dataType).alias(f.name) for f in fields])) if fields else F.lit(None).cast("string")
    if isinstance(kind, t.ArrayType):
        return F.transform(value, lambda x: _clean(x, kind.elementType))
    if isinstance(kind, t.MapType):
        open_ = F.map_filter(value, lambda k, _: ~F.lower(k.cast("string")).rlike(SECRET.pattern)) if isinstance(kind.keyType, t.StringType) else value
        return F.transform_values(open_, lambda _, v: _clean(v, kind.valueType))
    return value


def secret_names(schema: t.DataType, prefix: str = "") -> list[str]:
    """The secret-like field names of a schema, with their paths."""
    if isinstance(schema, t.StructType):
        return [x for f in schema.fields for x in ([prefix + f.name] if SECRET.search(f.name) else []) + secret_names(f.dataType, f"{prefix}{f.name}.")]
    if isinstance(schema, t.ArrayType):
        return secret_names(schema.elementType, prefix)
    return secret_names(schema.valueType, prefix) if isinstance(schema, t.MapType) else []
