import sys

from tensorloom.cli import main

sys.exit(main())
