"""Fetching of manifest sources into a folder: the one part that must run outside the plan, kept small and checked."""

from __future__ import annotations

import ipaddress
import shutil
import socket
import urllib.request
from hashlib import sha256
from pathlib import Path
from urllib.parse import urljoin, urlsplit

from lipika.sources.files import MAX_BYTES

REDIRECTS = 5


def safe_url(url: str) -> tuple[bool, str]:
    """Scheme http(s), a host, and no address of it private, loopback, link-local, reserved or multicast."""
    parts = urlsplit(url or "")
    if parts.scheme not in ("http", "https") or not parts.hostname:
        return False, "scheme or host"
    if parts.hostname.lower() in ("localhost", "ip6-localhost"):
        return False, "loopback name"
    try:
        found = {x[4][0] for x in socket.getaddrinfo(parts.hostname, None)}
    except OSError:
        return False, "name not resolved"
    for a in found:
        ip = ipaddress.ip_address(a.split("%")[0])
        if not ip.is_global or ip.is_multicast or ip.is_reserved:
            return False, f"address {a} not public"
    return True, "ok"


def safe_path(path: str, base: str) -> Path:
    """The path if it exists under the base folder; raises ValueError otherwise."""
    target, root = Path(path).resolve(), Path(base).resolve()
    if not target.is_relative_to(root) or not target.exists():
        raise ValueError(f"{path} is not a file under {base}")
    return target


class _NoRedirect(urllib.request.HTTPRedirectHandler):
    def redirect_request(self, *_):
        return None


def fetch(url: str, folder: str, title: str = "", base: str = ".", most: int = MAX_BYTES, timeout: float = 60.0, keep: int | None = None) -> Path:
    """Copy a local file under `base`, or download an address, every hop of which is checked; at most `most` bytes.

    With `keep`, a file already there that is larger than so many bytes is taken as it is."""
    name = "".join(c if c.isalnum() else "_" for c in (title or "source").lower())[:60]
    dest = Path(folder) / f"{name}_{sha256(url.encode()).hexdigest()[:24]}{Path(urlsplit(url).path).suffix or '.bin'}"
    dest.parent.mkdir(parents=True, exist_ok=True)
    if keep is not None and dest.exists() and dest.stat().st_size > keep:
        return dest
    if urlsplit(url).scheme in ("", "file"):
        source = safe_path(urlsplit(url).path, base)
        if source.stat().st_size > most:
            raise ValueError("file too large")
        shutil.copyfile(source, dest)
        return dest
    opener = urllib.request.build_opener(_NoRedirect)
    for _ in range(REDIRECTS + 1):
        ok, why = safe_url(url)
        if not ok:
            raise ValueError(why)
        try:
            with opener.open(urllib.request.Request(url, headers={"User-Agent": "lipika"}), timeout=timeout) as r:
                data = r.read(most + 1)
        except urllib.error.HTTPError as e:
            if e.code in (301, 302, 303, 307, 308) and e.headers.get("Location"):
                url = urljoin(url, e.headers["Location"])
                continue
            raise
        if len(data) > most:
            raise ValueError("response too large")
        dest.write_bytes(data)
        return dest
    raise ValueError("too many redirects")
