"""Which reporting tags may stand in for which statement item.

A rule names a target item, a case-insensitive pattern and its candidate tags. `allow` lists the
candidates; a rule without `allow` is open: every tag that matches the pattern and is not in `deny`.
Candidates are tried by how many firm-years report them, see `operators.canonical`.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    target: str
    pattern: str
    allow: tuple[str, ...] = ()
    deny: tuple[str, ...] = ()

    @property
    def is_open(self) -> bool:
        return not self.allow

    def matches(self, tag: Column) -> Column:
        """Candidate test for a tag column."""
        listed = ~tag.isin(*self.deny) if self.deny else F.lit(True)
        if not self.is_open:
            listed = tag.isin(*self.allow)
        return tag.rlike(f"(?i){self.pattern}") & listed

    def accepts(self, tag: str) -> bool:
        """Candidate test for one known tag, used when the plan is laid out."""
        listed = tag in self.allow if self.allow else tag not in self.deny
        return listed and re.search(self.pattern, tag, re.IGNORECASE) is not None


# Target items, search patterns and tag names, in execution order.
RULES: tuple[Rule, ...] = (
    Rule("Revenues", "revenue", deny=("CostOfRevenue", "InterestRevenueExpenseNet")),
    Rule("AccountsReceivable", "Receivable", (
        "AccountsReceivableNetCurrent",
        "ReceivablesNetCurrent",
        "AccountsReceivableGrossCurrent",
        "AccountsNotesAndLoansReceivableNetCurrent",
        "AccountsReceivableNet",
        "AccountsAndOtherReceivablesNetCurrent",
        "AccountsReceivableNetNoncurrent",
        "AccountsReceivableRelatedPartiesCurrent",
        "AccountsReceivableGross",
        "AccountsAndNotesReceivableNet",
        "ReceivablesFromCustomers",
        "AccountsReceivableSale",
        "AccountsReceivableGrossNoncurrent",
    )),
    Rule("CurrentAssets", "Current", ("AssetsCurrent", "OtherAssetsCurrent")),
    Rule("CurrentLiabilities", "Current", (
        "LiabilitiesCurrent",
        "OtherLiabilitiesCurrent",
        "OtherAccruedLiabilitiesCurrent",
        "ContractWithCustomerLiabilityCurrent",
    )),
    Rule("Inventory", "inventory", (
        "InventoryNet",
        "InventoryFinishedGoodsNetOfReserves",
        "InventoryFinishedGoods",
        "InventoryGross",
        "LIFOInventoryAmount",
        "InventoryNoncurrent",
        "InventorySuppliesNetOfReserves",
    )),
    Rule("Equity", "equity", (
        "StockholdersEquity",
        "StockholdersEquityIncludingPortionAttributableToNoncontrollingInterest",
        "StockholdersEquityOther",
    )),
    Rule("NetIncomeLoss", "income", (
        "NetIncomeLoss",
        "ComprehensiveIncomeNetOfTax",
        "OperatingIncomeLoss",
        "IncomeLossFromContinuingOperationsBeforeIncomeTaxesForeign",
        "IncomeLossFromContinuingOperationsBeforeIncomeTaxesDomestic",
    )),
    Rule("Assets", "Assets", ("Assets",)),
    Rule("CostGoodsSold", "Cost", ("CostOfGoodsAndServicesSold", "CostOfRevenue")),
    Rule("DepreciationAmortization", "Depreciation", (
        "DepreciationDepletionAndAmortization",
        "Depreciation",
        "DepreciationAndAmortization",
        "DepreciationAmortizationAndAccretionNet",
        "DepreciationNonproduction",
    )),
    Rule("PropertyPlantAndEquipment", "plant", (
        "PropertyPlantAndEquipmentNet",
        "PropertyPlantAndEquipmentGross",
        "PropertyPlantAndEquipmentAdditions",
        "PropertyPlantAndEquipmentOther",
        "PropertyPlantAndEquipmentDisposals",
        "PropertyPlantAndEquipmentAndFinanceLeaseRightOfUseAssetAfterAccumulatedDepreciationAndAmortization",
    )),
    Rule("LongTermDebt", "long", (
        "LongTermDebtNoncurrent",
        "LongTermDebt",
        "LongTermDebtAndCapitalLeaseObligations",
        "LongTermDebtFairValue",
        "OtherLongTermDebt",
        "UnsecuredLongTermDebt",
    )),
    Rule("FixedAssets", "assets", ("NoncurrentAssets", "AssetsNoncurrent")),
    Rule("OperatingIncomeLoss", "operating", ("OperatingIncomeLoss", "OtherOperatingIncome")),
    Rule("Interest", "Interest", (
        "InterestExpense",
        "InterestPaidNet",
        "InterestPaid",
        "InterestExpenseOther",
    )),
    Rule("PreTaxIncome", "income", (
        "IncomeLossFromContinuingOperationsBeforeIncomeTaxesForeign",
        "IncomeLossFromContinuingOperationsBeforeIncomeTaxesMinorityInterestAndIncomeLossFromEquityMethodInvestments",
        "IncomeLossFromContinuingOperationsBeforeIncomeTaxesExtraordinaryItemsNoncontrollingInterest",
    )),
    Rule("Cash", "cash", (
        "CashAndCashEquivalentsAtCarryingValue",
        "CashCashEquivalentsRestrictedCashAndRestrictedCashEquivalentsPeriodIncreaseDecreaseIncludingExchangeRateEffect",
        "CashCashEquivalentsRestrictedCashAndRestrictedCashEquivalents",
        "Cash",
        "CashEquivalentsAtCarryingValue",
        "CashAndCashEquivalentsFairValueDisclosure",
    )),
    Rule("Dividend", "dividend", (
        "PaymentsOfDividendsCommonStock",
        "DividendsCommonStockCash",
        "PaymentsOfDividends",
        "DividendsCash",
        "DividendsCommonStock",
        "Dividends",
        "DividendsPreferredStock",
        "DividendsCommonStockStock",
    )),
    Rule("CashFlowOperations", "cash", (
        "NetCashProvidedByUsedInOperatingActivities",
        "NetCashProvidedByUsedInOperatingActivitiesContinuingOperations",
        "CashProvidedByUsedInOperatingActivitiesDiscontinuedOperations",
    )),
    Rule("ResearchDevelopment", "Research", (
        "ResearchAndDevelopmentExpense",
        "ResearchAndDevelopmentExpenseExcludingAcquiredInProcessCost",
        "ResearchAndDevelopmentExpenseSoftwareExcludingAcquiredInProcessCost",
        "OtherResearchAndDevelopmentExpense",
    )),
)

# The items of the panel that feed the features.
PANEL_ITEMS: tuple[str, ...] = (
    "Revenues",
    "AccountsReceivable",
    "CurrentAssets",
    "CurrentLiabilities",
    "Equity",
    "NetIncomeLoss",
    "Assets",
    "DepreciationAmortization",
    "PropertyPlantAndEquipment",
    "FixedAssets",
    "Interest",
    "PreTaxIncome",
    "Cash",
    "CashFlowOperations",
)

# The wider scenario: every rule's target becomes a column.
ALL_ITEMS: tuple[str, ...] = tuple(rule.target for rule in RULES)

# Fiscal years of the panel and of the constituent list.
PANEL_YEARS: tuple[int, ...] = tuple(range(2017, 2023))
CONSTITUENT_YEARS: tuple[int, ...] = tuple(range(2015, 2023))

# Identifiers that neither directory resolves.
MANUAL_IDENTIFIERS: tuple[tuple[int, str], ...] = (
    (1769824, "AABA"),
    (1867883, "ANDV"),
    (1310243, "ANRZQ"),
    (14693, "BF.B"),
    (1067983, "BRK.B"),
    (1064728, "BTUUQ"),
    (1620546, "BXLT"),
    (1629995, "CPGX"),
    (1646383, "CSRA"),
    (1024333, "DISCK"),
    (801898, "JOY"),
    (813828, "VIAB"),
    (865436, "WFM"),
)
