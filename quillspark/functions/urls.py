"""URL functions."""

from __future__ import annotations

from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, functions as F, types as T


PARTS = r"^(?:([A-Za-z][\w+.-]*):)?(?://([^/?#]*))?([^?#]*)(.*)$"


def normalised(url: Column) -> Column:
    """Without a default port (the host is then in lower case) and without slashes at the path's end; query and fragment stay, relative URLs too."""
    part = lambda k: F.regexp_extract(url, PARTS, k)
    scheme, host = F.lower(part(1)), part(2)
    default = ((scheme == "http") & host.rlike(":80$")) | ((scheme == "https") & host.rlike(":443$"))
    host = F.when(default, F.lower(F.regexp_replace(host, "^.*@|:[0-9]+$", ""))).otherwise(host)
    return F.concat(F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise(""), F.when(url.rlike("^(?:[A-Za-z][\\w+.-]*:)?//"), F.concat(F.lit("//"), host)).otherwise(""), F.regexp_replace(part(3), "/+$", ""), part(4))


def sub_path(root: Column, url: Column) -> Column:
    """Whether the URL begins with the root, both normalised."""
    return F.startswith(normalised(url), normalised(root))


#: Hosts of one video site, list prefixes that can't be fetched.
VIDEO_HOSTS = ["www.youtube.com", "youtube.com", "m.youtube.com", "youtu.be"]
LIST_PREFIXES = ["RD", "RDMM", "RDEM", "RDCMUC", "RDAMVM", "RDTMVM"]


def video_host(url: Column) -> Column:
    return F.regexp_extract(url, PARTS, 2).isin(VIDEO_HOSTS)


def unviewable_list(url: Column) -> Column:
    """Whether the first `list` of the query begins with one of LIST_PREFIXES."""
    named = F.regexp_extract(url, r"^[^?#]*\?(?:[^#]*?&)?list=([^&#]*)", 1)
    return F.exists(F.array(*map(F.lit, LIST_PREFIXES)), lambda p: F.startswith(named, p))


def file_name(url: Column, limit: int = 220) -> Column:
    """The last part of the path, unquoted, blanks as _; longer ones lose the end of their stem; no path: root."""
    path = F.regexp_replace(F.regexp_extract(url, PARTS, 3), "/+$", "")
    name = F.when(path == "", "root").otherwise(F.element_at(F.split(path, "/"), -1))
    name = F.replace(F.call_function("try_url_decode", F.replace(name, F.lit("+"), F.lit("%2B"))), F.lit(" "), F.lit("_"))
    ext = F.regexp_extract(name, r"^.+(\.[^.]*)$", 1)
    stem = F.substring(name, F.lit(1), F.length(name) - F.length(ext))
    return F.when(F.length(name) > limit, F.concat(F.substring(stem, F.lit(1), F.lit(limit) - F.length(ext)), ext)).otherwise(name)


def without_hash(url: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(url, "#"), 1), "/$", "")


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][\w+.-]*://([^/?#]*)", 1))


def links(html: Column) -> Column:
    """Distinct targets of the links of a page, in order."""
    found = F.regexp_extract_all(html, F.lit(r"""(?i)<a\s(?:[^>]*?\s)?href\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""), 1)
    return F.array_distinct(F.transform(found, lambda x: F.regexp_replace(x, "^[\"']|[\"']$", "")))


@F.pandas_udf(T.ArrayType(T.StringType()))
def joined(base: pd.Series, targets: pd.Series) -> pd.Series:
    """Absolute targets, by RFC 3986, distinct; blank ones and those that lead nowhere (#, javascript:, mailto:, tel:, data:, in any case) give the base."""
    nowhere = ("#", "javascript:", "mailto:", "tel:", "data:")
    to = lambda b, t: b if not t or t.isspace() or t.lower().startswith(nowhere) else urljoin(b, t)
    return pd.Series([list(dict.fromkeys(to(b, t) for t in (ts if ts is not None else []))) for b, ts in zip(base, targets)])
