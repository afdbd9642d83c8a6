import sys

from fernlight.plans.cli import main

sys.exit(main())
