"""DataFrame operators for labelled 3-D point clouds."""
