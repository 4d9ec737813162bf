"""What the byte-level functions raise."""


class FilterError(ValueError):
    """Data that a filter cannot read, or a filter that does not exist."""


class ImageError(ValueError):
    """An image file that cannot be read, or of a kind that is not supported."""
