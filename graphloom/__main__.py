from graphloom.cli import main

raise SystemExit(main())
