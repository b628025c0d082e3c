import sys

from comboscan.plans.run import main

main(sys.argv[1:])
