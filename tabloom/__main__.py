import sys

from tabloom.cli import main

sys.exit(main())
