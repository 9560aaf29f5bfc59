import sys

from fieldcohort.cli import main

sys.exit(main())
