"""URL expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names of query parameters that only track visitors.
TRACKING = r"(?i)^(utm_[^=]*|fbclid[^=]*|gclid[^=]*|ref|ref_[^=]*)(=.*)?$"


def normalized(url: Column) -> Column:
    """https where there is no scheme, lower-case scheme and host without its own port, a path, blanks encoded, no
    fragment, no tracking parameters. A query that has none stays as it is; else empty parameters go and bare names get
    an equals sign."""
    u = F.trim(url)
    u = F.when(u.rlike("(?i)^https?://"), u).otherwise(F.concat(F.lit("https://"), u))
    scheme = F.lower(F.regexp_extract(u, "^([a-zA-Z]+)://", 1))
    login = F.regexp_extract(u, r"^[^/?#]*//([^/?#]*@)", 1)
    host = F.lower(F.regexp_extract(u, r"^[^/?#]*//(?:[^/?#]*@)?([^/?#]*)", 1))
    host = F.when(scheme == "https", F.regexp_replace(host, ":(443)?$", "")).otherwise(F.regexp_replace(host, ":(80)?$", ""))
    path = F.replace(F.regexp_extract(u, r"^[^/?#]*//[^/?#]*(/[^?#]*)", 1), F.lit(" "), F.lit("%20"))
    query = F.regexp_extract(u, r"^[^?#]*(\?[^#]*)", 1)
    all_ = F.split(F.substring(query, 2, 1 << 30), "&")
    kept = F.transform(F.filter(all_, lambda p: ~p.rlike(TRACKING) & (p != "")), lambda p: F.replace(F.when(p.contains("="), p).otherwise(F.concat(p, F.lit("="))), F.lit(" "), F.lit("+")))
    rebuilt = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    query = F.when(F.exists(all_, lambda p: p.rlike(TRACKING)), rebuilt).otherwise(F.replace(query, F.lit(" "), F.lit("%20")))
    return F.concat(scheme, F.lit("://"), login, host, F.when(path == "", "/").otherwise(path), query)
