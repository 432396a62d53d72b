"""``python -m diffsignal QUERY [TABLES]``: run a named query, or list all of them."""

from __future__ import annotations

import sys

from .plans.catalog import QUERIES
from .session import session


def main(args: list[str]) -> int:
    if not args or args[0] not in QUERIES:
        print("\n".join(sorted(QUERIES)))
        return 2 if args else 0
    spark = session()
    QUERIES[args[0]](spark, args[1] if len(args) > 1 else ".").show(50, truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
