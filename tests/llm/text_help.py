"""What the tests of the text operators share."""

SMALL = "/root/testdata/sf0.001"
