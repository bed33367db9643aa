"""WARC records as bytes: one gzip member for each record."""

from __future__ import annotations

import base64
import hashlib
import zlib
from urllib.parse import quote, unquote, urlsplit

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
GZIP = 16 + zlib.MAX_WBITS
LEVEL = 4
END = b"\r\n"

# Characters of a URL that a header line keeps; the others are percent-encoded.
URL_SAFE = "!#$%&'()*+,/:;=?@[]~-._"


def base32_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def url_key(url: str | None) -> str:
    """Key that sorts the pages of a host together: host parts in reverse, then path and query.

    Scheme, user, default port, a leading ``www.``, letter case of the host and the fragment do
    not count. A null URL has an empty key; one that cannot be parsed is its own key.
    """
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip())
        port = parts.port
    except ValueError:
        return url.strip()
    host = (parts.hostname or "").removeprefix("www.")
    if not host:
        return url.strip()
    key = ",".join(reversed(host.split(".")))
    if port and (parts.scheme, port) not in (("http", 80), ("https", 443)):
        key += f":{port}"
    return f"{key}){parts.path or '/'}" + (f"?{parts.query}" if parts.query else "")


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{name}: {value}\r\n" for name, value in headers)
    raw = head.encode() + f"Content-Length: {len(block)}\r\n".encode() + END + block + END + END
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, GZIP)
    return packer.compress(raw) + packer.flush()


def http_head(payload_bytes: int) -> bytes:
    return (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" f"Content-Length: {payload_bytes}\r\n\r\n"
    ).encode()


def capture_headers(
    kind: str, identity: str, url: str | None, stamp: str, page: str | None, digest: str
) -> list[tuple[str, str]]:
    headers = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", f"<urn:uuid:{identity}>"),
        ("WARC-Date", f"{stamp[:4]}-{stamp[4:6]}-{stamp[6:8]}T{stamp[8:10]}:{stamp[10:12]}:{stamp[12:14]}Z"),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    if url is not None:
        headers.append(("WARC-Target-URI", quote(url, safe=URL_SAFE)))
    if page is not None:
        headers.append(("X-Page-ID", quote(page)))
    return headers


def response(identity: str, url: str | None, stamp: str, page: str | None, digest: str, payload: bytes) -> bytes:
    headers = capture_headers("response", identity, url, stamp, page, digest)
    return record(headers, http_head(len(payload)) + payload)


def revisit(
    identity: str, url: str | None, stamp: str, page: str | None, digest: str, payload_bytes: int,
    first: str, first_page: str | None,
) -> bytes:
    """A record without payload that names the record with the same payload."""
    headers = capture_headers("revisit", identity, url, stamp, page, digest)
    headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:uuid:{first}>")]
    if first_page is not None:
        headers.append(("X-Refers-To-Page-ID", quote(first_page)))
    return record(headers, http_head(payload_bytes))


def parsed(member: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers and payload of one gzip member; names in lower case."""
    raw = zlib.decompress(member, GZIP)
    head, _, rest = raw.partition(END + END)
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record starts here")
    headers = dict(_header(line) for line in lines[1:])
    block = rest[: int(headers["content-length"])]
    if rest[len(block) :] != END + END:
        raise ValueError("a WARC record has another length than it says")
    http, _, payload = block.partition(END + END)
    return headers, dict(_header(line) for line in http.decode().split("\r\n")[1:]), payload


def _header(line: str) -> tuple[str, str]:
    name, _, value = line.partition(":")
    name, value = name.strip().lower(), value.strip()
    return name, unquote(value) if name.startswith("x-") else value
