from chatloom.cli import main

main()
