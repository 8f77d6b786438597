"""python -m brindle"""

from .plans.cli import main

raise SystemExit(main())
