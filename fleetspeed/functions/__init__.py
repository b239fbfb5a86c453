"""Column functions: no DataFrame is read or built here, so batch and streaming share them."""
