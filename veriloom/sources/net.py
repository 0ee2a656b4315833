"""Network edges: URL guards, body decoding, accountable fetching.  Off unless a caller runs them."""

from __future__ import annotations

import ipaddress
import os
import socket
import time
import urllib.error
import urllib.request
from collections.abc import Callable
from email.message import Message
from urllib.parse import urljoin, urlsplit

MAX_BYTES = 5_000_000
AGENT = "veriloom/0.1"


def secret(name: str) -> str:
    """The value of an environment variable that must be set."""
    value = os.environ.get(name, "")
    if not value:
        raise ValueError(f"no credential: {name} is not set")
    return value


def decode_body(body: bytes, content_type: str = "") -> str:
    """By the charset of the content type, else as UTF-8 with replacements."""
    m = Message()
    m["content-type"] = content_type or "text/plain"
    charset = m.get_content_charset() or "utf-8"
    try:
        return body.decode(charset)
    except (LookupError, UnicodeDecodeError):
        return body.decode("utf-8", "replace")


def is_private(host: str, resolve: Callable[[str], list[str]] | None = None) -> bool:
    """Any address of the host is not public; a host that does not resolve is refused too."""
    try:
        found = [host.strip("[]")] if _address(host) else (resolve or _resolve)(host)
    except OSError:
        return True
    return not found or any((a := _address(x)) is None or not a.is_global or a.is_multicast for x in found)


def _address(text: str):
    try:
        return ipaddress.ip_address(text.strip("[]").partition("%")[0])
    except ValueError:
        return None


def _resolve(host: str) -> list[str]:
    return [info[4][0] for info in socket.getaddrinfo(host, None)]


def checked_url(url: str, resolve: Callable[[str], list[str]] | None = None) -> str:
    """The URL, if it is http(s) with a public host; else a ValueError before any request."""
    p = urlsplit(url)
    if p.scheme not in ("http", "https"):
        raise ValueError(f"refused scheme: {p.scheme or 'none'}")
    if not p.hostname or is_private(p.hostname, resolve):
        raise ValueError("refused host: not public")
    return url


class _NoRedirect(urllib.request.HTTPRedirectHandler):
    def redirect_request(self, *args, **kwargs):
        return None


class Transient(OSError):
    """A failure that may pass: 5xx, timeouts, refused connections."""


def transport(url: str, headers: dict[str, str], timeout: float, max_bytes: int, hops: int = 10) -> dict:
    """One request; redirects are followed by hand, each hop guarded, and secrets are not sent to another origin."""
    opener, sent, chain, first = urllib.request.build_opener(_NoRedirect), dict(headers), [], urlsplit(url)
    for _ in range(hops + 1):
        checked_url(url)
        try:
            with opener.open(urllib.request.Request(url, headers=sent), timeout=timeout) as r:
                body = r.read(max_bytes + 1)
                return {"final_url": url, "status": r.status, "headers": list(r.headers.items()), "body": body[:max_bytes], "truncated": len(body) > max_bytes, "redirects": chain}
        except urllib.error.HTTPError as e:
            if e.code >= 500:
                raise Transient(f"HTTP {e.code}") from e
            target = e.headers.get("Location")
            if e.code in (301, 302, 303, 307, 308) and target:
                chain.append({"status": e.code, "location": target})
                url = urljoin(url, target)
                now = urlsplit(url)
                if (now.scheme, now.netloc) != (first.scheme, first.netloc):
                    sent = {k: v for k, v in sent.items() if k.lower() not in ("authorization", "cookie")}
                continue
            body = b"" if e.code == 304 else e.read(max_bytes + 1)
            return {"final_url": url, "status": e.code, "headers": list(e.headers.items()), "body": body[:max_bytes], "truncated": len(body) > max_bytes, "redirects": chain}
        except (urllib.error.URLError, TimeoutError, ConnectionError) as e:
            raise Transient(str(e)) from e
    raise ValueError("too many redirects")


def fetch(url: str, *, headers: dict[str, str] | None = None, etag: str = "", last_modified: str = "", timeout: float = 20.0, max_bytes: int = MAX_BYTES, retries: int = 2, backoff: float = 0.5, send: Callable[..., dict] = transport, sleep: Callable[[float], None] = time.sleep) -> dict:
    """A response row (url, final_url, status, headers, body, attempts, truncated); transient failures are tried again, later
    each time.  `truncated`: the body went on beyond max_bytes, so its hash is not that of the whole."""
    sent = {"User-Agent": AGENT, **(headers or {}), **({"If-None-Match": etag} if etag else {}), **({"If-Modified-Since": last_modified} if last_modified else {})}
    for attempt in range(1, retries + 2):
        try:
            got = send(url, sent, timeout, max_bytes)
        except Transient:
            if attempt > retries:
                raise
            sleep(backoff * 2 ** (attempt - 1))
            continue
        body = None if got["status"] == 304 else got["body"]
        return {"url": url, "final_url": got["final_url"], "status": got["status"], "headers": [{"k": k, "v": v} for k, v in got["headers"]], "body": body, "attempts": attempt, "truncated": bool(got.get("truncated"))}
    raise AssertionError
