from gradeweave.plans.cli import main

raise SystemExit(main())
