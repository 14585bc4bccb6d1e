from tillflow.cli import main

main()
