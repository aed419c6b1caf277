"""Chat messages in, structured reply blocks out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.text import tidy_reply

MAX_USER_CHARS = 400

# Fixed value: questions that ask for a comparison.
COMPARISON = (
    r"(?iU)\b(?:сравн\w*|сопостав\w*|отлич(?:а|и|е)\w*|разниц\w*|что\s+лучше|како[йюаяе]\s+(?:из\s+них\s+)?лучше|"
    r"како[йюаяе]\s+(?:из\s+них\s+)?выбрать|выбрать\s+между|плюсы\s+и\s+минусы)\b"
)

# The markers of a reply and the longest texts in them.
MARKER = r"(?i)\[id\s*:\s*\d+\]|\[compare\s*:\s*\d+\s*\|\s*[^\]\r\n]{1,240}\]|\[compare_result\s*:\s*[^\]\r\n]{1,500}\]"
NOTE_CHARS, ANALYSIS_CHARS = 240, 500
NO_CATEGORY = "Другие товары"


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def validate(messages: DataFrame, most: int = MAX_USER_CHARS) -> DataFrame:
    """(conv_id, reason): why a conversation is rejected, null if it is not. The first bad message in
    turn order gives the reason; blank messages do not count."""
    text = _strip(F.coalesce("text", F.lit("")))
    reason = (
        F.when(~F.coalesce(F.col("role").isin("user", "assistant"), F.lit(False)), "bad_role")
        .when(F.col("text").isNull(), "bad_text")
        .when((F.col("role") == "user") & (F.length(text) > most), "user_text_too_long")
    )
    checked = messages.select("conv_id", "turn", reason.alias("r"), ((F.col("role") == "user") & (text != "")).alias("asks"))
    return checked.groupBy("conv_id").agg(
        F.coalesce(F.min_by("r", F.when(F.col("r").isNotNull(), F.col("turn"))), F.when(~F.coalesce(F.bool_or("asks"), F.lit(False)), "no_user_message")).alias("reason")
    )


def normalise_messages(messages: DataFrame) -> DataFrame:
    return messages.withColumn("text", _strip(F.col("text"))).filter("text <> ''")


def wants_comparison(messages: DataFrame) -> DataFrame:
    """(conv_id, comparison): whether the latest user message asks to compare."""
    said = normalise_messages(messages.filter("role = 'user'"))
    return said.groupBy("conv_id").agg(F.max_by("text", "turn").alias("t")).select("conv_id", F.col("t").rlike(COMPARISON).alias("comparison"))


def catalog_lines(products: DataFrame, query: str = "query_id", rank: str = "rank") -> DataFrame:
    """(query, lines): retrieved products as a table of bars for a prompt, in rank order."""
    cell = lambda c: F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("/"))
    line = F.concat_ws("|", *[cell(c) for c in ("id", "name", "brand", "price", "subcategory")])
    return products.groupBy(query).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(rank, line.alias("l")))), lambda x: x["l"]), "\n").alias("lines"))


def scrub(text: Column, secrets: list[str]) -> Column:
    for secret in secrets:
        if len(secret) > 5:
            text = F.replace(text, F.lit(secret), F.lit("***"))
    return text


def with_markers(replies: DataFrame, limit: int = 10) -> DataFrame:
    """``text`` with a marker behind the first mention of each product that has none: of its name or
    else of its article number (three signs at least). The first ``limit`` products that are mentioned
    get one; of markers that fall on one place the later product's stands first."""
    low = F.col("__low")
    mention = lambda key, least: F.when(F.length(key) >= least, F.nullif(F.position(F.lower(key), low), F.lit(0)) - 1 + F.length(key))
    place = lambda p, i: F.struct(F.coalesce(mention(F.trim(p["name"]), 1), mention(F.trim(p["sku"]), 3)).alias("at"), (-i).alias("back"), p["id"].alias("id"))
    out = replies.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("__low", F.lower("text"))
    out = out.withColumn("__has", F.regexp_extract_all("text", F.lit(r"(?i)\[id\s*:\s*(\d+)\]"), F.lit(1)))
    out = out.withColumn("__all", F.coalesce(F.transform("products", place), F.array().cast("array<struct<at:int,back:int,id:string>>")))
    out = out.withColumn("__put", F.filter("__all", lambda p: p["at"].isNotNull() & ~F.array_contains(F.col("__has"), p["id"])))
    out = out.withColumn("__put", F.array_sort(F.slice("__put", 1, limit)))
    from_ = F.concat(F.array(F.lit(0)), F.col("__put.at"))
    piece = lambda p, start: F.when(p.isNull(), F.substring("text", start + 1, F.length("text"))).otherwise(F.concat(F.substring("text", start + 1, p["at"] - start), F.lit(" [id:"), p["id"], F.lit("]")))
    return out.withColumn("text", F.array_join(F.zip_with("__put", from_, piece), "")).drop("__low", "__has", "__all", "__put")


def marker_places(replies: DataFrame) -> DataFrame:
    """Every marker of a reply, by ``place``, with the text ``before`` it: ``kind``, ``product_id`` and
    ``note``; the last place of each reply has no marker, only the rest of the text."""
    places = F.zip_with(F.split("text", MARKER, -1), F.regexp_extract_all("text", F.lit(MARKER), F.lit(0)), lambda b, m: F.struct(b.alias("before"), m.alias("m")))
    keep = [c for c in replies.columns if c != "text"]
    rows = replies.select(*keep, F.posexplode(places).alias("place", "p")).select(*keep, "place", "p.*")
    note = F.regexp_extract("m", r"(?is)^\[(?:compare\s*:\s*\d+\s*\||compare_result\s*:)(.*)\]$", 1)
    return rows.select(
        *keep, "place", "before", F.lower(F.regexp_extract("m", r"^\[(\w+)", 1)).alias("kind"),
        F.nullif(F.regexp_extract("m", r"(?i)^\[(?:id|compare)\s*:\s*(\d+)", 1), F.lit("")).alias("product_id"), tidy_reply(note).alias("note"),
    )


def content_blocks(replies: DataFrame, limit: int = 10) -> DataFrame:
    """Blocks of many replies: msg_id, block_no, type (text, product, comparison_item,
    comparison_analysis), text, product_id.

    ``replies``: msg_id, text and ``products`` (array of id, name, sku with distinct ids: what was
    retrieved, and what the reply may name). A product is shown at its first marker, for the first
    ``limit`` of them; a compared item at its first marker with a note; an analysis where two items
    stand before it. Of the text before a product its bare name at the end goes, before other markers
    that bring nothing the headings at the end. Windows over one reply say what came before; nothing
    runs row by row.
    """
    rows = marker_places(with_markers(replies.select(F.col("msg_id").cast("string").alias("msg_id"), "text", "products"), limit))
    named = F.get(F.filter("products", lambda p: p["id"] == F.col("product_id")), F.lit(0))
    rows = rows.withColumn("name", F.trim(named["name"])).withColumn("known", named.isNotNull()).drop("products")
    reply = Window.partitionBy("msg_id").orderBy("place")
    so_far = reply.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    noted = (F.col("kind") == "compare") & F.col("known") & (F.col("note") != "")
    first = F.row_number().over(Window.partitionBy("msg_id", "product_id", "kind").orderBy("place")) == 1
    rows = rows.withColumn("opens", F.col("known") & (F.col("kind") == "id") & first)
    rows = rows.withColumn("first_note", F.min(F.when(noted, F.col("place"))).over(Window.partitionBy("msg_id", "product_id")))
    rows = rows.withColumn("shows", F.col("opens") & (F.count_if(F.col("opens")).over(so_far) <= limit)).withColumn("item", noted & (F.col("first_note") == F.col("place")))
    rows = rows.withColumn("items", F.count_if(F.col("item")).over(so_far))
    analyses = (F.col("kind") == "compare_result") & (F.col("items") >= 2)
    # a marker without a note, of a product not compared yet, leaves the text as it is
    plain = F.col("item") | analyses | (F.col("kind") == "") | ((F.col("kind") == "compare") & F.col("known") & (F.coalesce("first_note", "place") >= F.col("place")))
    bare_name = F.concat(F.lit(r"(?isU)\s*\Q"), F.col("name"), F.lit(r"\E[ \t:;,.—–()-]*\z"))
    headings = r"(?U)(?:(?:^|\n)(?:[^\n]*[:：])?[^\S\n]*)+\z"
    said = (
        F.when(F.col("shows") & (F.coalesce("name", F.lit("")) != ""), F.regexp_replace("before", bare_name, F.lit("")))
        .when(F.col("shows") | plain, F.col("before"))
        .otherwise(F.regexp_replace("before", headings, ""))
    )
    none = F.lit(None).cast("string")
    block = lambda type_, text, product: F.struct(F.lit(type_).alias("type"), text.alias("text"), product.alias("product_id"))
    text = F.nullif(tidy_reply(said), F.lit(""))
    shown = (
        F.when(F.col("shows"), block("product", none, F.col("product_id")))
        .when(F.col("item"), block("comparison_item", F.substring("note", 1, NOTE_CHARS), F.col("product_id")))
        .when(analyses & (F.col("note") != ""), block("comparison_analysis", F.substring("note", 1, ANALYSIS_CHARS), none))
    )
    blocks = rows.select("msg_id", "place", F.posexplode(F.array_compact(F.array(F.when(text.isNotNull(), block("text", text, none)), shown))).alias("part", "b"))
    number = F.row_number().over(Window.partitionBy("msg_id").orderBy("place", "part")) - 1
    return blocks.select("msg_id", number.alias("block_no"), "b.type", "b.text", "b.product_id")


def group_blocks(blocks: DataFrame, products: DataFrame, most: int = 3) -> DataFrame:
    """Neighbouring products of a category as one group, compared items likewise (``most`` of them;
    groups of one compared item go): msg_id, block_no of the first, type, category, product_ids, text."""
    named = blocks.join(products.select(F.col("id").alias("product_id"), F.coalesce(F.nullif("category", F.lit("")), F.lit(NO_CATEGORY)).alias("category")), "product_id", "left")
    along = Window.partitionBy("msg_id").orderBy("block_no")
    grouped = F.col("type").isin("product", "comparison_item")
    same = grouped & (F.lag("type").over(along) == F.col("type")) & (F.lag("category").over(along) == F.col("category"))
    islands = named.withColumn("_new", F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1)).withColumn("_island", F.sum("_new").over(along))
    out = islands.groupBy("msg_id", "_island", "type").agg(
        F.min("block_no").alias("block_no"),
        F.first("category").alias("category"),
        F.transform(F.array_sort(F.collect_list(F.struct("block_no", "product_id", "text"))), lambda x: F.struct(x["product_id"].alias("product_id"), x["text"].alias("text"))).alias("items"),
    )
    out = out.withColumn("items", F.when(F.col("type") == "comparison_item", F.slice("items", 1, most)).otherwise(F.col("items")))
    return out.filter("type <> 'comparison_item' OR size(items) >= 2").select(
        "msg_id", "block_no", F.when(F.col("type") == "product", "product_group").when(F.col("type") == "comparison_item", "comparison").otherwise(F.col("type")).alias("type"), "category", "items"
    )


def markers(replies: DataFrame) -> DataFrame:
    """(msg_id, place, kind, product_id, text) of every marker."""
    found = marker_places(replies.select("msg_id", "text")).filter("kind <> ''")
    return found.select("msg_id", "place", "kind", "product_id", F.nullif("note", F.lit("")).alias("text"))
