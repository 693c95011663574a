"""Tests of the corpus operators; a package, as a module here has the name of one in the folder above."""
