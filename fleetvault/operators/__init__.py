"""Set-wise operators over the catalogue relations."""
