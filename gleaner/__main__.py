"""python -m gleaner"""

import sys

from gleaner.cli import main

sys.exit(main())
