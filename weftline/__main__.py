"""``python -m weftline <command>``."""

import sys

from weftline.commands.cli import main

if __name__ == "__main__":
    sys.exit(main())
