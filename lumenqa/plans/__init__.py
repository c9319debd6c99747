

from lumenqa.plans import registry  # noqa: F401 - loads the query modules in an order that lets them use each other
