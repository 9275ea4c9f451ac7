"""Model calls as relations, and the iterative loops built on them."""
