"""Identifiers: name-based UUIDs and checksums."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the URL namespace of RFC 4122.
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


def uuid5(name: Column, namespace: str = URL_NAMESPACE) -> Column:
    """Version 5 UUID of ``name`` as text; NULL for NULL."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "UTF-8")))

    def layout(h: Column) -> Column:
        variant_byte = F.conv(F.substring(h, 17, 2), 16, 10).cast("long")
        variant = F.lower(F.hex(variant_byte.bitwiseAND(F.lit(63)).bitwiseOR(F.lit(128))))
        return F.concat_ws(
            "-",
            F.substring(h, 1, 8),
            F.substring(h, 9, 4),
            F.concat(F.lit("5"), F.substring(h, 14, 3)),
            F.concat(variant, F.substring(h, 19, 2)),
            F.substring(h, 21, 12),
        )

    # Through an array of one, so that the digest is computed once.
    return F.when(name.isNotNull(), F.transform(F.array(digest), layout)[0])


def video_uuid(video_id: Column, uri: Column, md5: Column) -> Column:
    """The video id itself, else a UUID of uri and checksum, else NULL."""
    return F.when(video_id.isNotNull(), video_id).when(
        uri.isNotNull() & md5.isNotNull(), uuid5(F.concat(uri, md5))
    )


def idp_uuid(video: Column, position: Column) -> Column:
    """Stable key of the n-th product of a video, so that a retry repeats it."""
    return uuid5(F.concat_ws("#", video, position.cast("string")))


def md5_hex(md5_base64: Column) -> Column:
    """Object-store checksum (base64) as lower-case hex."""
    return F.lower(F.hex(F.unbase64(md5_base64)))
