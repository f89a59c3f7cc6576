"""Archive file names: 14-digit times, host identity, and patterns with named fields."""

from __future__ import annotations

import re
import socket
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: prefix, time, serial number and host, as the WARC standard recommends, in the notation of `positional`.
DEFAULT_PATTERN = "%{prefix}s%{ts}s-%04{serial}d-%{hostOrIp}s.%{ext}s"
_NAMED = re.compile(r"%([-+ 0#,(]*\d*(?:\.\d+)?)\{(\w+)\}([a-zA-Z])")


def utc14(time: Column | str) -> Column:
    """yyyyMMddHHmmss in UTC."""
    t = F.col(time) if isinstance(time, str) else time
    return F.date_format(F.to_utc_timestamp(t, F.current_timezone()), "yyyyMMddHHmmss")


def positional(pattern: str) -> tuple[str, list[str]]:
    """The pattern for format_string, and the names of its arguments in order."""
    names: list[str] = []

    def put(m: re.Match) -> str:
        names.append(m[2])
        return f"%{len(names)}${m[1]}{m[3]}"

    return _NAMED.sub(put, pattern), names


def host_name() -> str:
    try:
        return socket.gethostname() or "unknown"
    except OSError:
        return "unknown"


def outbound_ip() -> str:
    """The address that this host would send from; nothing is sent."""
    try:
        with socket.socket(socket.AF_INET, socket.SOCK_DGRAM) as s:
            s.connect(("192.0.2.1", 9))
            return s.getsockname()[0]
    except OSError:
        return "unknown"


def host_or_ip() -> str:
    name = host_name()
    return name if name != "unknown" else outbound_ip()


def file_name(serial: Column, time: Column, *, prefix: str = "", ext: str = "warc", pattern: str = DEFAULT_PATTERN, params: Mapping[str, object] | None = None, host: str | None = None, ip: str | None = None) -> Column:
    """A file name for each row. Own parameters never replace the built-in ones; an unknown name is an error."""
    form, names = positional(pattern)
    given: dict[str, Column] = {k: F.lit(v) for k, v in (params or {}).items()}
    given |= {"ts": utc14(time), "serial": serial, "prefix": F.lit(prefix), "ext": F.lit(ext)}
    given |= {"ip": F.lit(ip or outbound_ip()), "host": F.lit(host or host_name()), "hostOrIp": F.lit(host or ip or host_or_ip())}
    if missing := [n for n in names if n not in given]:
        raise ValueError(f"the pattern names unknown parameters: {', '.join(missing)}")
    return F.format_string(form, *[given[n] for n in names])
