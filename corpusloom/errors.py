"""What can go wrong, by kind."""


class LoomError(Exception):
    """Base of all errors of this package."""


class NotPositive(LoomError):
    """A search was asked for no or fewer items."""


class NoDocuments(LoomError):
    """The store, or the document searched within, has no pieces."""


class DocumentNotFound(LoomError):
    """No document has the uuid."""


class DuplicateDocument(LoomError):
    """A uuid or title is taken."""


class NoText(LoomError):
    """A text piece without text."""


class NoData(LoomError):
    """An image piece without data."""


class NoValidContent(LoomError):
    """A piece of an unknown kind."""


class DimensionMismatch(LoomError):
    """A vector isn't of the provider's dimension."""


class CouldNotEmbed(LoomError):
    """The model gave no vector."""


class MissingModelFile(LoomError):
    """A model folder lacks its vocabulary or configuration."""


class DigestError(LoomError):
    """Base of what a source may raise."""


class NotAFile(DigestError):
    pass


class FileNotReadable(DigestError):
    pass


class EmptyFile(DigestError):
    pass


class UnknownExtension(DigestError):
    pass


class FileTypeNotValid(DigestError):
    pass


class NoAvailableSource(DigestError):
    pass


class ImageNotValid(DigestError):
    pass
