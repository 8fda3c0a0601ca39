"""python -m kindred [dedup | remove-like | select] ... [--config FILE]"""

from __future__ import annotations

import json
import sys

from kindred.plans.app import WORKFLOWS
from kindred.plans.options import OptionError, options
from kindred.plans.session import session


def main(argv: list[str]) -> int:
    try:
        o = options(argv)
        print(json.dumps(WORKFLOWS[o.command](session(), o), indent=2))
    except (OptionError, FileExistsError, ValueError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
