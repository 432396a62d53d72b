"""What a review target is: pull or merge request, repository, or a local path."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Hosts by provider, and what stands before the number of a change there.
HOSTS = {"github.com": "github", "gitlab.com": "gitlab", "codeberg.org": "codeberg"}
CHANGES = {"github": ("pr", "pull"), "gitlab": ("mr", "merge_requests"), "codeberg": ("pr", "pulls")}


def classify_target(target: Column | str) -> Column:
    """struct(provider, kind, root, owner, repo, number); anything else is a path of the file system, null is null.

    The address is split at slashes.  Behind a known host stand the owner (on
    gitlab a path of groups) and the repository, and behind these the word for
    a change and its number.
    """
    t = F.col(target) if isinstance(target, str) else target
    none = F.lit(None).cast("string")

    def struct(provider: str, kind: Column, owner: Column, repo: Column, number: Column) -> Column:
        return F.struct(F.lit(provider).alias("provider"), kind.alias("kind"), t.alias("root"), owner.alias("owner"), F.regexp_replace(repo, r"\.git$", "").alias("repo"), number.alias("number"))

    out = struct("filesystem", none, none, none, none)
    for host, provider in reversed(HOSTS.items()):
        kind, word = CHANGES[provider]
        tail = F.split(F.substring_index(t, f"{host}/", -1), "/")
        place = F.array_position(tail, word).cast("int")  # from 1; 0 where there is none
        digits = F.regexp_extract(F.get(tail, place), r"^\d+", 0)
        names = F.slice(tail, 1, F.greatest(place - (2 if provider == "gitlab" else 1), F.lit(0)))
        grouped = provider == "gitlab"
        filled = lambda a: F.forall(a, lambda x: x != "")
        enough = (F.size(names) >= 2) if grouped else (F.size(names) == 2)
        fits = (place > 0) & (digits != "") & enough & filled(names)
        if grouped:
            fits &= F.get(tail, place - 2) == "-"
        split = lambda a: (F.array_join(F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))), "/"), F.get(a, F.size(a) - 1))
        plain = F.when((F.size(tail) > 1) & (F.get(tail, F.size(tail) - 1) == ""), F.slice(tail, 1, F.greatest(F.size(tail) - 1, F.lit(0)))).otherwise(tail)
        whole = ((F.size(plain) >= 2) if grouped else (F.size(plain) == 2)) & filled(plain) & ~F.get(plain, F.size(plain) - 1).rlike("[?#]")
        here = F.contains(t, F.lit(f"{host}/"))
        out = F.when(here & fits, struct(provider, F.lit(kind), *split(names), digits)).when(here & whole, struct(provider, F.lit("repo"), *split(plain), none)).otherwise(out)
    return F.when(t.isNotNull(), out)


def parse_pull_url(url: Column | str, strict: bool = False) -> Column:
    """struct(owner, repo, number) of an anchored pull-request address; else null, or with ``strict`` an error."""
    u = F.col(url) if isinstance(url, str) else url
    pattern = r"^https://github\.com/([^/]+)/([^/]+)/pull/(\d+)/?$"
    part = lambda i: F.regexp_extract(u, pattern, i)
    found = F.struct(part(1).alias("owner"), part(2).alias("repo"), part(3).cast("int").alias("number"))
    return F.when(u.rlike(pattern), found).otherwise(F.raise_error(F.concat(F.lit("no pull request: "), F.coalesce(u, F.lit("null")))) if strict else F.lit(None))


def reporter_of(provider: Column | str, has_token: Column) -> Column:
    """Who delivers a review: github and gitlab with a token, else nobody."""
    p = F.col(provider) if isinstance(provider, str) else provider
    return F.when(p.isin("github", "gitlab") & has_token, p)
