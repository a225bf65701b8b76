"""Texts that results show."""

# Labels of the two roles, the dash for a missing value, the status
# line of an opened document by where it is read from, and the answer to a grant.
MAINTAINER = "Maintainer"
READER = "Reader"
MISSING = "-"
READING = "Reading "
OFFLINE = " (Offline)"
ONLINE = " (Online)"
GRANTED_BEFORE = "Successfully made "
GRANTED_AFTER = " a maintainer."
