"""String expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Label order of the two embedding texts.
PRODUCT_LABELS = [
    "Title",
    "Brand",
    "Product Category",
    "Product Type",
    "Age Group",
    "Color",
    "Gender",
    "Material",
    "Pattern",
    "Description",
]
IDENTIFIED_LABELS = [
    "Title",
    "Description",
    "Color, Pattern, Style, Usage",
    "Category",
    "Subcategory",
]

# Bucket URI, keyword and whitespace patterns. Word characters are
# spelled as letters, numbers and '_' so that every script counts.
URI_PATTERN = r"^(?:gs://)?([a-z0-9._-]+)/(.+)$"
KEYWORD_PATTERN = r"([\p{L}\p{N}_-]+)"
SPACE_PATTERN = r"[\s\p{Z}]+"

# The characters that count as white space at the ends of a text.
SPACE_CHARACTERS = (
    " \t\n\v\f\r\x1c\x1d\x1e\x1f\x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Known listing strategies, the first is the fallback.
STRATEGIES = ["PRESERVE", "PURGE"]

# Prefixes of stored failure messages and their default texts.
FAILURE_PREFIX = {"offer": "Fatal: ", "request": "Critical Worker Fail: "}
DEFAULT_OFFER_ERROR = "Mutate operation failed"
CORRUPT_DEPLOYMENT = "Corrupt deployment metadata (missing customer/campaign/offers)"


def is_blank(c: Column) -> Column:
    """True for NULL and for the empty string."""
    return c.isNull() | (c == "")


def blank_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def strip(c: Column) -> Column:
    """Trim every kind of whitespace, not only blanks."""
    return F.btrim(c, F.lit(SPACE_CHARACTERS))


def labelled_lines(labels: list[str], cols: list[Column]) -> Column:
    """``Label: value`` lines; NULL and '' are left out, blanks alone are kept."""
    if len(labels) != len(cols):
        raise ValueError(f"{len(labels)} labels for {len(cols)} columns")
    lines = [
        F.when(c != "", F.concat(F.lit(f"{label}: "), c))
        for label, c in zip(labels, cols, strict=True)
    ]
    return F.concat_ws("\n", *lines)


def product_text(
    title: Column,
    brand: Column,
    category: Column,
    product_type: Column,
    age_group: Column,
    color: Column,
    gender: Column,
    material: Column,
    pattern: Column,
    description: Column,
) -> Column:
    return labelled_lines(
        PRODUCT_LABELS,
        [title, brand, category, product_type, age_group, color, gender, material,
         pattern, description],
    )


def identified_text(
    title: Column, description: Column, style: Column, category: Column, subcategory: Column
) -> Column:
    return labelled_lines(
        IDENTIFIED_LABELS, [title, description, style, category, subcategory]
    )


def search_keywords(title: Column, video_id: Column) -> Column:
    """Distinct lower-case words of title and video id."""
    text = F.concat_ws(
        " ", F.coalesce(title, F.lit("")), F.coalesce(video_id, F.lit(""))
    )
    return F.array_distinct(
        F.regexp_extract_all(F.lower(text), F.lit(KEYWORD_PATTERN), F.lit(1))
    )


# Fixed value: tokens of a search term that are looked up.
MAX_SEARCH_TOKENS = 30


def search_tokens(term: Column | str, n: int | None = None, tokenize: str = "space") -> Column:
    """Lower-case tokens of a text: all, or the first ``n`` of them.

    ``tokenize="space"`` splits on whitespace only, so "shoes!" stays one token;
    ``"regex"`` cuts words the same way the stored keywords are cut.
    """
    text = F.lower(F.lit(term) if isinstance(term, str) else term)
    if tokenize == "regex":
        tokens = F.regexp_extract_all(text, F.lit(KEYWORD_PATTERN), F.lit(1))
    elif tokenize == "space":
        tokens = F.filter(F.split(text, SPACE_PATTERN), lambda t: t != "")
    else:
        raise ValueError(f"unknown tokenize mode: {tokenize}")
    tokens = F.coalesce(tokens, F.array().cast("array<string>"))
    return tokens if n is None else F.slice(tokens, 1, n)


def split_uri(uri: Column) -> Column:
    """struct(bucket, path), or NULL where the text is no bucket URI."""
    return F.when(
        uri.rlike(URI_PATTERN),
        F.struct(
            F.regexp_extract(uri, URI_PATTERN, 1).alias("bucket"),
            F.regexp_extract(uri, URI_PATTERN, 2).alias("path"),
        ),
    )


def normalize_customer_id(c: Column) -> Column:
    """Drop hyphens; NULL, '' and the number 0 become ''."""
    text = c.cast("string")
    number_zero = (F.typeof(c) != "string") & (text == "0")
    return F.when(text.isNull() | number_zero, F.lit("")).otherwise(
        F.regexp_replace(text, "-", "")
    )


def parse_strategy(c: Column) -> Column:
    up = F.upper(c.cast("string"))
    return F.when(up.isin(STRATEGIES), up).otherwise(F.lit(STRATEGIES[0]))


def join_messages(messages: Column) -> Column:
    """Distinct non-blank messages in first-seen order, joined by '; '."""
    kept = F.filter(messages, lambda m: m.isNotNull() & (m != ""))
    return F.concat_ws("; ", F.array_distinct(kept))


def brand_at_start(title: Column, brand: Column) -> Column:
    return F.coalesce(
        ~is_blank(title) & ~is_blank(brand) & F.startswith(F.lower(title), F.lower(brand)),
        F.lit(False),
    )


def brand_part(title: Column, brand: Column) -> Column:
    return F.when(
        brand_at_start(title, brand), F.substr(title, F.lit(1), F.length(brand))
    ).otherwise(F.lit(""))


def title_rest(title: Column, brand: Column) -> Column:
    return F.when(
        brand_at_start(title, brand), F.substr(title, F.length(brand) + 1)
    ).otherwise(title)


def video_title(title: Column, uri: Column, video_id: Column, uuid: Column) -> Column:
    """Stored title, else file name, else video id, else uuid."""
    file_name = F.when(uri != "", F.element_at(F.split(uri, "/"), -1))
    return F.coalesce(blank_to_null(title), file_name, blank_to_null(video_id), uuid)


def split_ids(c: Column, keep_blank: bool = True) -> Column:
    """Comma-separated ids, stripped; NULL and '' give an empty array."""
    ids = F.transform(F.split(c, ","), strip)
    if not keep_blank:
        ids = F.filter(ids, lambda x: x != "")
    return F.when(c != "", ids).otherwise(F.array().cast("array<string>"))


def sorted_ids(ids: Column) -> Column:
    return F.concat_ws(",", F.array_sort(ids))


def doc_key(prefix: str, c: Column) -> Column:
    return F.concat(F.lit(prefix), c.cast("string"))


def strip_key(prefix: str, c: Column) -> Column:
    """Remove one leading ``prefix``; other values pass through."""
    return F.when(F.startswith(c, F.lit(prefix)), F.substr(c, F.lit(len(prefix) + 1))).otherwise(c)


def name_with_id(name: Column, ident: Column) -> Column:
    """``name (id)``, or the id alone when there is no name."""
    text = ident.cast("string")
    return F.when(is_blank(name), text).otherwise(
        F.concat(name, F.lit(" ("), text, F.lit(")"))
    )


def failure_message(kind: str, message: Column) -> Column:
    return F.concat(F.lit(FAILURE_PREFIX[kind]), message)
