"""Object stores: which root a configuration means, and signed links to objects, made as column expressions."""

from __future__ import annotations

import datetime
import hashlib
import hmac
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of the public signing scheme, version 4.
ALGORITHM, SERVICE, TERMINATOR = "AWS4-HMAC-SHA256", "s3", "aws4_request"
#: Bytes of a SHA-256 block.
BLOCK = 64


def store_root(settings: Mapping[str, str | None]) -> str:
    """Root path of the configured store: a bucket if the backend is s3 and a bucket is named, else the local root."""
    if settings.get("backend") == "s3" and settings.get("bucket"):
        return f"s3a://{settings['bucket']}"
    return settings.get("root") or "storage"


def pads(key: bytes) -> tuple[bytes, bytes]:
    """Inner and outer block of an HMAC with SHA-256."""
    key = (hashlib.sha256(key).digest() if len(key) > BLOCK else key).ljust(BLOCK, b"\0")
    return bytes(b ^ 0x36 for b in key), bytes(b ^ 0x5C for b in key)


def hmac_sha256(key: bytes, message: Column) -> Column:
    """Lower-case hex HMAC of a text under a constant key: two SHA-256 of the JVM for each row, no Python."""
    inner, outer = (F.lit(bytearray(p)) for p in pads(key))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(message, "UTF-8")), 256))), 256)


def signing_key(secret: str, day: str, region: str) -> bytes:
    """Key of one day, region and service, derived from the secret."""
    key = ("AWS4" + secret).encode()
    for part in (day, region, SERVICE, TERMINATOR):
        key = hmac.new(key, part.encode(), hashlib.sha256).digest()
    return key


def encoded_path(key: Column) -> Column:
    """An object key percent-encoded but for slashes, as RFC 3986 wants it."""
    out = F.url_encode(key)
    for old, new in (("+", "%20"), ("*", "%2A"), ("%7E", "~"), ("%2F", "/")):
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def presigned(key: Column, bucket: str, access: str, secret: str, region: str, at: datetime.datetime, seconds: int = 3600, host: str | None = None) -> Column:
    """A link by which anyone may read the object ``key`` for ``seconds`` (an hour) from ``at`` (UTC); null for a null key.

    The request is signed with the key of the day, which stands in the plan as a constant; the secret does not.
    Links depend on nothing but the row, so they are made where the rows are.
    """
    if not 1 <= seconds <= 604800:
        raise ValueError("a link lives for one second to seven days")
    stamp = at.strftime("%Y%m%dT%H%M%SZ")
    scope = "/".join([stamp[:8], region, SERVICE, TERMINATOR])
    host = host or f"{bucket}.{SERVICE}.{region}.amazonaws.com"
    fields = f"X-Amz-Algorithm={ALGORITHM}&X-Amz-Credential={(access + '/' + scope).replace('/', '%2F')}&X-Amz-Date={stamp}&X-Amz-Expires={seconds}&X-Amz-SignedHeaders=host"
    path = encoded_path(key)
    request = F.concat(F.lit("GET\n/"), path, F.lit(f"\n{fields}\nhost:{host}\n\nhost\nUNSIGNED-PAYLOAD"))
    signature = hmac_sha256(signing_key(secret, stamp[:8], region), F.concat(F.lit(f"{ALGORITHM}\n{stamp}\n{scope}\n"), F.sha2(request, 256)))
    return F.concat(F.lit(f"https://{host}/"), path, F.lit(f"?{fields}&X-Amz-Signature="), signature)
