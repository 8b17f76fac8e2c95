"""Named queries over the derived assertion log."""
