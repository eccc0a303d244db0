from conforank.cli import main

main()
