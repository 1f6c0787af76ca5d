"""``python -m clonespark``."""

import sys

from clonespark.cli import main

sys.exit(main())
